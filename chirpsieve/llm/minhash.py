"""Document fingerprints: MinHash of word shingles.

Each shingle's 32-bit hash x goes through K multiply-add-shift hashes
(a x + b) >> 32 (a strongly universal family), in numpy blocks; the signature
is the K minima, and the fingerprint its low bytes. Bands of the signature are
joined in Spark, and Jaccard is verified on the shingle sets.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, mix, rolling, text_keys, word_hashes
from .groups import connected, shingle_set, sizes_fit, whole_sets

SHINGLE, HASHES, BLOCK = 5, 128, 1024
_rng = np.random.default_rng(20_240_607)
_A = _rng.integers(0, 2**63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, HASHES, dtype=np.uint64)
_NONE = np.full(HASHES, np.iinfo(np.uint64).max, dtype=np.uint64)
BASE = 0x9E3779B97F4A7C15


def shingles(x: np.ndarray, size: int) -> np.ndarray:
    """32-bit hashes of the word shingles; fewer words make one shingle, none none."""
    if not len(x):
        return x
    return mix(rolling(x, min(size, len(x)), BASE)) >> np.uint64(32)


def minima(s: np.ndarray) -> np.ndarray:
    out = _NONE.copy()
    for at in range(0, len(s), BLOCK):
        v = _A[:, None] * s[None, at : at + BLOCK]
        v += _B[:, None]
        np.minimum(out, (v >> np.uint64(32)).min(axis=1), out=out)
    return out


def lanes(sig: np.ndarray) -> bytes:
    """The fingerprint: the low byte of each minimum (all 255 where there are no words)."""
    return sig.astype(np.uint8).tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """Share of equal lanes, less the 1 in 256 that agree by chance: an estimate of Jaccard in 0..1."""
    same = np.count_nonzero(np.frombuffer(a, np.uint8) == np.frombuffer(b, np.uint8)) / len(a)
    return max(0.0, (same - 1 / 256) / (1 - 1 / 256))


def _words(t: str) -> list[bytes]:
    return t.encode().split()


class Document:
    """A text with its word hashes and signature."""

    def __init__(self, text: str, size: int):
        self.text, self.size = text, size
        self.x = word_hashes(_words(text))
        self.sig = None

    def edited(self, follower: str) -> tuple[str, bytes, bytes]:
        """The edited text, its fingerprint and this text's: what both share is hashed once."""
        t, n = self.text, len(self.text)
        cut = n - n // 4
        head, more = t[:cut], follower[: n // 4]
        ws = _words(head)
        if ws and head[-1] not in " \t\n\r\x0b\x0c":
            ws.pop()  # the last word may go on
            at = max(head.rfind(c) for c in " \t\n\r\x0b\x0c") + 1
        else:
            at = cut
        y = np.concatenate([self.x[: len(ws)], word_hashes(_words(t[at:cut] + more))])
        a, b = shingles(self.x, self.size), shingles(y, self.size)
        same = max(0, min(len(ws) - self.size + 1, len(a), len(b))) if min(len(self.x), len(y)) >= self.size else 0
        shared = minima(a[:same])
        if self.sig is None:
            self.sig = np.minimum(shared, minima(a[same:]))
        return head + more, lanes(np.minimum(shared, minima(b[same:]))), lanes(self.sig)

    def lanes(self) -> bytes:
        if self.sig is None:
            self.sig = minima(shingles(self.x, self.size))
        return lanes(self.sig)


def signatures(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """doc_id, k1, k2 (keys of the text), c1, c2 (key of its shingle set), n (its size), sig (K 32-bit minima) of each row; null is empty."""

    def run(batches):
        for batch in batches:
            c, n, sig = [], [], []
            for t in batch["text"].to_pylist():
                h = shingle_set((t or "").encode(), size)
                c.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
                n.append(len(h))
                sig.append(minima(h >> np.uint64(32)).astype("<u4").tobytes())
            c = np.array(c, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k1"], batch["k2"], pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(n, pa.int32()), pa.array(sig, pa.binary())], ["doc_id", "k1", "k2", "c1", "c2", "n", "sig"])

    return docs.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(run, "doc_id long, k1 long, k2 long, c1 long, c2 long, n int, sig binary")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, similarity: float = 0.8, bands: int = 32) -> DataFrame:
    """doc_id, class_id, component_id for each row: class = equal shingle sets, component = classes linked at Jaccard >= similarity.

    Classes that share a band of the signature are candidates, and all pairs of
    a band's classes that aren't connected by others are verified on their whole
    sets, in blocks. 32 bands of 4
    minima miss a pair of Jaccard 0.8 once in 2 x 10^7. The ids are the smallest
    doc_ids (null where all are null). Null and empty texts have the empty set
    and are one class; repeated rows are repeated; other columns are ignored.
    """
    w = materialize(signatures(docs, size))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    nodes = materialize(w.groupBy("c1", "c2").agg(first, F.first("n").alias("n"), F.first("sig").alias("sig")))
    nodes = materialize(nodes.withColumn("node", F.monotonically_increasing_id()))
    width = 4 * HASHES // bands
    keys = F.array(*[F.xxhash64(F.lit(i), F.expr(f"substring(sig, {i * width + 1}, {width})")) for i in range(bands)])
    rows = nodes.select("node", F.explode(keys).alias("key"))
    again = materialize(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "hub"))
    stars = rows.join(again, "key").select("hub", "node").distinct()

    def sets(some):
        return whole_sets(docs, nodes.join(some, "node"), size)

    label = connected(materialize(stars), nodes.select("node", "n"), sets, lambda n: sizes_fit(n, similarity), similarity).withColumnRenamed("node", "of")
    per = nodes.select("c1", "c2", "node", "first").join(label, F.col("node") == F.col("of"), "left").select("c1", "c2", "first", F.coalesce("label", "node").alias("label"))
    best = per.groupBy("label").agg(F.min("first").alias("best"))
    ids = per.join(best, "label").select("c1", "c2", F.col("first.doc_id").alias("class_id"), F.col("best.doc_id").alias("component_id"))
    return w.select("doc_id", "c1", "c2").join(ids, ["c1", "c2"]).select("doc_id", "class_id", "component_id")


_OUT = "part int, kind int, doc_id long, n_chars long, sha string, fp binary, edited_fp binary, near_edited double, near_next double, text string"


def _row(doc_id, d: Document, nxt: Document) -> tuple:
    edited, efp, fp = d.edited(nxt.text)
    return (doc_id, len(d.text), hashlib.sha256(edited.encode()).hexdigest(), fp, efp, likeness(fp, efp), likeness(fp, nxt.lanes()))


def edited_fingerprints(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """For each row its fingerprint and that of its text edited with the next document's (ascending doc_id, nulls last, ties by text hash).

    Texts are range-partitioned once and streamed in order. The last row of a
    partition waits for the next partition's first one: these boundary rows
    (two a partition) are joined afterwards. A single row is its own next; null
    text is empty; an empty one has the fingerprint of no words and is like
    another empty one at 1.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    src = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("k1", F.xxhash64("text"))
    # the row's number splits rows that are equal in all else, so that they are no hot key
    order = [F.asc_nulls_last("doc_id"), F.col("k1"), F.col("row_")]
    src = src.withColumn("row_", F.monotonically_increasing_id()).repartitionByRange(n, *order).sortWithinPartitions(*order)
    schema = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), ("sha", pa.string()), ("fp", pa.binary()), ("edited_fp", pa.binary()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])

    def run(batches):
        part, held, held_id = TaskContext.get().partitionId(), None, None

        def edge(kind, doc_id, text):
            return (part, kind, doc_id, None, None, None, None, None, None, text)

        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                now = Document(text, size)
                if held is None:
                    rows.append(edge(2, doc_id, text))
                else:
                    rows.append((part, 0, *_row(held_id, held, now), None))
                held, held_id = now, doc_id
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        if held is not None:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(edge(1, held_id, held.text)), schema)], schema=schema)

    done = materialize(src.select("doc_id", "text").mapInArrow(run, _OUT))
    heads = done.where("kind = 2").select("part", F.col("text").alias("next_text"))
    order = Window.orderBy("part")  # a row for each partition
    follow = heads.select("part", F.coalesce(F.lead("part").over(order), F.min("part").over(Window.partitionBy())).alias("next_part"))
    tails = done.where("kind = 1").select("part", "doc_id", "text").join(follow, "part")
    tails = tails.join(heads.select(F.col("part").alias("next_part"), "next_text"), "next_part").select("part", "doc_id", "text", "next_text")

    def last(batches):
        for batch in batches:
            rows = [(p, 0, *_row(i, Document(t, size), Document(x, size)), None) for p, i, t, x in zip(*(batch[c].to_pylist() for c in ("part", "doc_id", "text", "next_text")))]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    out = done.where("kind = 0").drop("text").union(tails.mapInArrow(last, _OUT).drop("text"))
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), F.lower(F.hex("fp")).alias("fingerprint"), F.lower(F.hex("edited_fp")).alias("edited_fingerprint"), "near_edited", "near_next")


def op9(spark, sf_dir):
    """The fingerprints of all documents and of their edited texts, as edited_fingerprints() defines them."""
    from .common import documents

    return edited_fingerprints(documents(spark, sf_dir))


def all_near_duplicates(spark, sf_dir):
    """near_duplicates() of all documents: the rest of the method, bands joined and Jaccard verified."""
    from .common import documents

    return near_duplicates(documents(spark, sf_dir))
