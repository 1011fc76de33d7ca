"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are read as lower-case letters, every run of other characters as one
space, also before and behind the text. The n-grams of one to four of these
fall into hashed buckets. Spark counts the buckets of every labelled document;
the log-probabilities (buckets x languages, at most MOST languages) are
broadcast, and batches of documents gather and sum their rows in numpy. Sums
are of whole numbers, so equal texts score alike wherever they stand.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, materialize, mix

BITS, ORDERS = 16, 4
SMOOTHING = 0.5  # added to every bucket's count
MOST = 256  # languages of a model: bounds the broadcast to MOST x 2^BITS numbers
SCALE = 1 << 12  # a log-probability's unit
PIECE = 1 << 20  # characters at a time
BASE = 0x9E3779B97F4A7C15  # an odd multiplier
SPACE = 32
UNKNOWN = "und"


@functools.cache
def folded() -> np.ndarray:
    """For every code point the lower-case letter it counts as; SPACE for what is no letter."""
    out = np.full(0x110000, SPACE, dtype=np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def pieces(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(codes, segment of each, whether an n-gram may end at it, row of each segment) for about PIECE characters at a time.

    A text longer than that comes in several segments, each of which repeats
    the end of the one before, so that no n-gram is lost or counted twice.
    """
    fold = folded()
    held, fresh, rows = [], [], []

    def out():
        seg = np.repeat(np.arange(len(held)), [len(x) for x in held])
        return np.concatenate(held), seg, np.concatenate(fresh), np.array(rows)

    for row, text in enumerate(texts):
        if not text:
            continue
        tail, n = np.array([SPACE], dtype=np.uint32), len(text) + 1
        for at in range(0, n, PIECE):
            part = text[at : at + PIECE] + (" " if at + PIECE >= n else "")
            c = fold[np.frombuffer(part.encode("utf-32-le"), dtype=np.uint32)]
            letter = c != SPACE
            c = c[letter | np.concatenate([[tail[-1] != SPACE], letter[:-1]])]
            old = len(tail) if at else 0
            c = np.concatenate([tail, c])
            held.append(c)
            fresh.append(np.arange(len(c)) >= old)
            rows.append(row)
            tail = c[-(ORDERS - 1) :]
            if sum(map(len, held)) >= PIECE or len(held) >= 4096:
                yield out()
                held, fresh, rows = [], [], []
    if held:
        yield out()


def grams(codes: np.ndarray, seg: np.ndarray, fresh: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, segment) of all n-grams, for each n in turn; segments stay in order."""
    h = np.zeros(len(codes), dtype=np.uint64)
    for n in range(1, ORDERS + 1):
        if len(codes) < n:
            return
        h = h[: len(codes) - n + 1] * np.uint64(BASE) + codes[n - 1 :]
        ok = fresh[n - 1 :] & (seg[n - 1 :] == seg[: len(codes) - n + 1])
        yield (mix(h[ok] + np.uint64(n)) >> np.uint64(64 - BITS)).astype(np.int64), seg[n - 1 :][ok]


def held_out(doc_id: str = "doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def count_grams(labelled: DataFrame) -> DataFrame:
    """lang, bucket, n: how often each bucket occurs in texts of each language; bucket -1 counts the documents.

    labelled: text, lang; rows without a language count for nothing, null and
    empty texts as documents only. Each task adds up its own rows first.
    """

    def run(batches):
        held: dict[str, np.ndarray] = {}

        def flush():
            for lang, n in held.items():
                b = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(b)), pa.array(b.astype(np.int32) - 1), pa.array(n[b])], ["lang", "bucket", "n"])
            held.clear()

        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            for lang in sorted(set(langs)):
                if lang not in held and len(held) == 64:
                    yield from flush()
                total = held.setdefault(lang, np.zeros((1 << BITS) + 1, dtype=np.int64))
                at = np.flatnonzero(langs == lang)
                total[0] += len(at)
                for codes, seg, fresh, _ in pieces(batch["text"].take(pa.array(at)).to_pylist()):
                    for bucket, _ in grams(codes, seg, fresh):
                        total[1:] += np.bincount(bucket, minlength=1 << BITS)
        yield from flush()

    rows = labelled.where("lang is not null").select("lang", "text").mapInArrow(run, "lang string, bucket int, n long")
    return rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def fit(labelled: DataFrame, most: int = MOST) -> dict:
    """The model of labelled documents (text, lang), all of which are counted: languages in order, log-probabilities, priors.

    Repeated rows count as often as they stand there. More than `most`
    languages raise, for the model is broadcast; no labelled rows make a model
    without languages.
    """
    counts = materialize(count_grams(labelled))
    docs = sorted((r.lang, r.n) for r in counts.where("bucket = -1").limit(most + 1).collect())
    if len(docs) > most:
        raise ValueError(f"more than {most} languages: the model would be too large to be broadcast")
    langs = [x for x, _ in docs]
    n = np.zeros((1 << BITS, len(langs)), dtype=np.int64)
    if langs:
        got = counts.where("bucket >= 0").toArrow()
        at = {x: i for i, x in enumerate(langs)}
        n[got["bucket"].to_numpy(), [at[x] for x in got["lang"].to_pylist()]] = got["n"].to_numpy()
    log = np.log((n + SMOOTHING) / (n.sum(0) + SMOOTHING * len(n)))
    known = np.array([x for _, x in docs], dtype=np.float64)
    prior = np.log((known + 1) / (known.sum() + len(langs)))
    return {"langs": langs, "log": np.rint(log * SCALE).astype(np.int32), "prior": np.rint(prior * SCALE).astype(np.int64)}


def decide(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The language and score of each text.

    Score: the posterior of its language with the evidence of the orders
    averaged, for n-grams of one text aren't independent. Ties fall to the
    language first in order. Without a letter, or without languages: UNKNOWN, 0.
    """
    langs, log = model["langs"], model["log"]
    sums, letters = np.zeros((len(texts), len(langs)), dtype=np.int64), np.zeros(len(texts), dtype=bool)
    if langs:
        for codes, seg, fresh, rows in pieces(texts):
            letters[rows[np.unique(seg[codes != SPACE])]] = True
            for bucket, of in grams(codes, seg, fresh):
                first = np.flatnonzero(np.diff(of, prepend=-1))
                if len(first):
                    np.add.at(sums, rows[of[first]], np.add.reduceat(log[bucket], first, axis=0, dtype=np.int64))
    if not langs or not len(texts):
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    x = model["prior"] + sums / ORDERS
    best = x.argmax(1)
    p = 1 / np.exp((x - x.max(1, keepdims=True)) / SCALE).sum(1)
    return [langs[b] if ok else UNKNOWN for b, ok in zip(best.tolist(), letters.tolist())], np.where(letters, p, 0.0)


def identify(docs: DataFrame, model: dict, keep: list[str], text: str = "text") -> DataFrame:
    """keep + lang_pred, score for each row of docs, from its text alone.

    Null texts and those without a letter are `und` with score 0; long texts are
    read whole; repeated rows score alike; an empty table stays empty. Other
    columns may have any names; lang_pred or score among `keep` raise.
    """
    if {"lang_pred", "score"} & set(keep):
        raise ValueError("lang_pred and score are made here: rename the columns of docs that are kept")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        for batch in batches:
            lang, p = decide(shared.value, batch.column(len(keep)).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang, pa.string()), pa.array(p, pa.float64())], [*keep, "lang_pred", "score"])

    return docs.select(*[F.col(f"`{c}`") for c in (*keep, text)]).mapInArrow(run, f"{kinds}, lang_pred string, score double")


def op11(spark, sf_dir):
    """doc_id, held_out, lang_pred, score of all documents, learned from all labelled ones that aren't held out."""
    docs = documents(spark, sf_dir)
    model = fit(docs.where(~held_out()).select("text", "lang"))
    return identify(docs, model, ["doc_id"]).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
