"""Packing: documents are concatenated and cut into sequences of fixed length.

Pass 1 tokenises once, counts the tokens of each partition and writes the ids;
prefix sums over the partition totals (one row a partition) give every document
its global offset. Pass 2 cuts at multiples of the sequence length and emits a
record for each piece.
"""

from __future__ import annotations

import re
import zlib
from itertools import filterfalse

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LENGTH, END = 2048, 1
CACHE = 1_000_000  # words that a worker remembers, at most
PIECE = 4_000_000  # bytes encoded at a time (a longer text alone)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


# ASCII signs (no apostrophe) that may stand behind a word, and words of lower-case Latin letters only.
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PLAIN = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class Encoder:
    """Ids of whole texts, word by word, for vocabularies with word ends and these rules: NFC, lower case, white space dropped.

    The rules never join across ASCII white space, so a text's ids are those of
    its words in turn, and repeated words come from a memory. Signs behind a
    word are pieces of their own. Words of plain letters are left as they are by
    the rules: they go through the merges in one string, and the ids that end a
    word cut the result. All other words are encoded one by one by the full rules.
    """

    def __init__(self, path: str):
        import tokenizers

        self.tokenizer = tokenizers.Tokenizer.from_file(path)
        self.plain = tokenizers.Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = tokenizers.pre_tokenizers.Sequence([tokenizers.pre_tokenizers.WhitespaceSplit(), tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.kind = np.dtype("<u2" if len(self.ends) <= 65536 else "<u4")
        self.memory: dict[bytes, bytes] = {}

    @classmethod
    def shared(cls, path: str) -> Encoder:
        """One for a vocabulary and process. This package travels by value, its modules end with a task; kept with the library, an encoder outlives it in a reused worker."""
        import tokenizers

        kept = tokenizers.__dict__.setdefault("chirpsieve_encoders", {})
        if path not in kept:
            kept[path] = cls(path)
        return kept[path]

    def _learn(self, new: set[bytes]) -> None:
        m, cut, pieces = self.memory, [], set()
        for w in new:
            if w[-1] in SIGNS and b"<|" not in w:
                stem = w.rstrip(SIGNS)
                if stem[-1:].isalnum():
                    cut.append((w, stem, w[len(stem) :]))
                    pieces.update(cut[-1][1:])
                    continue
            pieces.add(w)
        pieces = [w for w in pieces if w not in m]
        plain = [w for w in pieces if PLAIN.fullmatch(w)]
        for at in range(0, len(plain), 8192):
            some = plain[at : at + 8192]
            ids = np.array(self.plain.encode_batch_fast([b" ".join(some).decode()], add_special_tokens=False)[0].ids, dtype=self.kind)
            stops = (np.flatnonzero(self.ends[ids]) + 1) * self.kind.itemsize
            if len(stops) != len(some):
                raise ValueError("this vocabulary has no word ends to cut at")
            raw, stops = ids.tobytes(), stops.tolist()
            m.update(zip(some, (raw[a:b] for a, b in zip([0, *stops], stops))))
        rest = [w for w in pieces if w not in m]
        for at in range(0, len(rest), 4096):
            some = rest[at : at + 4096]
            for w, e in zip(some, self.tokenizer.encode_batch_fast([x.decode() for x in some], add_special_tokens=False)):
                m[w] = np.array(e.ids, dtype=self.kind).tobytes()
        for w, stem, signs in cut:
            m[w] = m[stem] + m[signs]

    def batch(self, texts: list[bytes]) -> list[bytes]:
        """Little-endian ids (of self.kind) of each text (UTF-8)."""
        m, parts = self.memory, []
        for b in texts:
            # lower case comes after NFC: where A-Z could meet a combining mark, or a special token is near, it is left to the rules
            parts.append((b if b"<|" in b or b"\xcc" in b or b"\xcd" in b else b.lower()).split())
        new: set[bytes] = set()
        for p in parts:
            new.update(filterfalse(m.__contains__, p))
        if len(m) + len(new) > CACHE:
            m.clear()
            new = set().union(*parts)
        self._learn(new)
        return [b"".join(map(m.__getitem__, p)) for p in parts]


def tokenise(docs: DataFrame, path: str, end: int) -> DataFrame:
    """doc_id, part, first (tokens of the partition before the document), n, ids (16 bits each, or 32 for larger vocabularies)."""

    def run(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        enc, part, first = Encoder.shared(path), TaskContext.get().partitionId(), 0
        width, tail = enc.kind.itemsize, np.array([end], dtype=enc.kind).tobytes()

        def rows(doc_ids, texts):
            nonlocal first
            ids = [x + tail for x in enc.batch(texts)]
            sizes = np.array([len(x) for x in ids], dtype=np.int64) // width
            starts = first + np.cumsum(sizes) - sizes
            first += int(sizes.sum())
            n = len(ids)
            return pa.RecordBatch.from_arrays([doc_ids, pa.array(np.full(n, part, np.int32)), pa.array(starts), pa.array(sizes), pa.array(ids, pa.binary()), pa.array(np.full(n, width, np.int32))], ["doc_id", "part", "first", "n", "ids", "width"])

        for batch in batches:
            at, held, size = 0, [], 0
            for t in batch["text"]:
                held.append(t.as_buffer().to_pybytes() if t.is_valid and t.as_buffer() is not None else b"")
                size += len(held[-1])
                if size >= PIECE:
                    yield rows(batch["doc_id"].slice(at, len(held)), held)
                    at, held, size = at + len(held), [], 0
            if held:
                yield rows(batch["doc_id"].slice(at, len(held)), held)

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, part int, first long, n long, ids binary, width int")


def pack(docs: DataFrame, vocabulary: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if wanted) of each piece.

    Null text is empty: its one id is `end`. Rows are packed as they come, so
    repeated rows, ties and null doc_ids are packed like any others. Only the
    last sequence is not full. Other columns are ignored.
    """
    tokens = materialize(tokenise(docs, vocabulary or default_vocabulary(), end))
    totals = tokens.groupBy("part").agg(F.sum("n").alias("total"))
    # one row for each input partition, so the window and the broadcast stay small
    base = totals.select(F.col("part").alias("p"), (F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("total")).alias("base"))
    rows = tokens.join(F.broadcast(base), F.col("part") == F.col("p")).select("doc_id", (F.col("base") + F.col("first")).alias("at"), "n", "ids", "width")

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(8)]
            for doc, at, n, ids, width in zip(batch["doc_id"].to_pylist(), batch["at"].to_pylist(), batch["n"].to_pylist(), batch["ids"], batch["width"].to_pylist()):
                x = np.frombuffer(ids.as_buffer(), "<u2" if width == 2 else "<u4").astype("<u4")
                start = 0
                while start < n:
                    seq, off = divmod(at + start, length)
                    size = min(n - start, length - off)
                    raw = x[start : start + size].tobytes()
                    for o, v in zip(out, (doc, start, size, zlib.crc32(raw), n, seq, off, raw if with_ids else b"")):
                        o.append(v)
                    start += size
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            cols = [pa.array(o, pa.int64()) for o in out[:7]]
            yield pa.RecordBatch.from_arrays([*cols, *([pa.array(out[7], pa.binary())] if with_ids else [])], [*names, *(["ids"] if with_ids else [])])

    return rows.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + ", ids binary" * with_ids)


def op8(spark, sf_dir):
    """The pieces of all documents, as pack() cuts them."""
    from .common import documents

    return pack(documents(spark, sf_dir))
