"""Substring dedup: words covered by a repeated window of fixed length are removed.

Every window has a Rabin-Karp hash. Before windows are counted in Spark, those
that cannot repeat are left out without loss: the k-word gram of least hash in
a window (its anchor) is the same wherever the window stands, so a window whose
anchor stands nowhere else is unique. About a tenth of all positions are
anchors. Copies of a whole text count as repeats at once, and only one of them
takes part in the rest, so a group of copies of any size makes rows for one.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, mix, rolling, text_keys, word_hashes, words

WINDOW = 35
# Odd multipliers of the polynomial hashes.
BASE_GRAM, BASE_WINDOW, BASE_CHECK = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F


def gram_size(window: int) -> int:
    return max(1, window // 2 - 1)


def anchors(ws: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, hashes of all k-word grams, and for each window the position of its anchor (leftmost of least hash)."""
    x = word_hashes(ws, 42)
    k = gram_size(window)
    g = mix(rolling(x, k, BASE_GRAM))
    span = window - k + 1
    if len(g) < span:
        return x, g, np.zeros(0, dtype=np.int64)
    # sliding minimum by doubling, position in step with it
    best, at, size = g, np.arange(len(g)), 1
    while size < span:
        step = min(size, span - size)
        left, right = best[:-step], best[step:]
        take = right < left
        best, at, size = np.where(take, right, left), np.where(take, at[step:], at[:-step]), size + step
    return x, g, at


def windows(x: np.ndarray, y: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of each window, of word hashes with two seeds: 128 bits in all."""
    return mix(rolling(x, window, BASE_WINDOW)), mix(rolling(y, window, BASE_CHECK))


def _bytes(scalar) -> bytes:
    return scalar.as_buffer().to_pybytes() if scalar.is_valid and scalar.as_buffer() is not None else b""


def _sha(ws: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(ws)).hexdigest()


def survey(docs: DataFrame, window: int) -> DataFrame:
    """doc_id, k1, k2, n_words, whole (SHA-256 of all words), anchors (hashes at distinct positions)."""

    def run(batches):
        for batch in batches:
            n, sha, found = [], [], []
            for t in batch["text"]:
                ws = words(_bytes(t))
                n.append(len(ws))
                sha.append(_sha(ws))
                if len(ws) >= window:
                    _, g, at = anchors(ws, window)
                    found.append(g[np.unique(at)].view(np.int64))
                else:
                    found.append(np.zeros(0, np.int64))
            ends = np.concatenate([[0], np.cumsum([len(f) for f in found])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found) if found else np.zeros(0, np.int64)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k1"], batch["k2"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), lists], ["doc_id", "k1", "k2", "n_words", "whole", "anchors"])

    src = docs.select("doc_id", *text_keys(F.col("text")), "text")
    return src.mapInArrow(run, "doc_id long, k1 long, k2 long, n_words long, whole string, anchors array<long>")


def window_rows(texts: DataFrame, window: int) -> DataFrame:
    """k1, k2, h, h2, s: the windows (hashes and start) of texts whose anchor is among the row's repeated ones."""

    def run(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                ws = words(_bytes(batch["text"][i]))
                x, g, at = anchors(ws, window)
                hit = np.flatnonzero(np.isin(g[at], np.asarray(batch["repeated"][i].values).view(np.uint64)))
                h, h2 = (v[hit] for v in windows(x, word_hashes(ws, 43), window))
                for p in range(0, len(hit), 65536):
                    m = len(hit[p : p + 65536])
                    key = [pa.array(np.full(m, batch[c][i].as_py(), np.int64)) for c in ("k1", "k2")]
                    yield pa.RecordBatch.from_arrays([*key, pa.array(h[p : p + m].view(np.int64)), pa.array(h2[p : p + m].view(np.int64)), pa.array(hit[p : p + m].astype(np.int32))], ["k1", "k2", "h", "h2", "s"])

    return texts.select("k1", "k2", "text", "repeated").mapInArrow(run, "k1 long, k2 long, h long, h2 long, s int")


def covered(starts: np.ndarray, n: int, window: int) -> np.ndarray:
    """Which of n words lie in a window that begins at one of starts: maximal removal intervals."""
    edge = np.zeros(n + 1, dtype=np.int64)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + window, -1)
    return np.cumsum(edge[:n]) > 0


def remove_repeats(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept, the text of kept words) for each row.

    A null or empty text has no words. Texts shorter than a window stay whole.
    A null doc_id is kept as it is; repeated rows are repeats of each other.
    Other columns are ignored.
    """
    w = materialize(survey(docs, window))
    copies = w.groupBy("k1", "k2").agg(F.count(F.lit(1)).alias("m"), F.min("doc_id").alias("one"))
    copies = materialize(copies.where("m > 1"))
    c = copies.select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "m", "one")
    same = (F.col("k1") == F.col("c1")) & (F.col("k2") == F.col("c2"))
    # one row of each text: its doc_id is the smallest (rows that repeat it wholly count as repeats anyway)
    base = w.where(F.size("anchors") > 0).join(c, same, "left").where(F.col("m").isNull() | F.col("doc_id").eqNullSafe(F.col("one"))).select("k1", "k2", "anchors").dropDuplicates(["k1", "k2"])
    a = base.select("k1", "k2", F.explode("anchors").alias("a"))
    # written first, so that both sides of the join are shuffles of their own and a hot key can be split
    again = materialize(a.groupBy("a").count().where("count > 1").select("a"))
    cand = materialize(a.join(again, "a").groupBy("k1", "k2").agg(F.collect_set("a").alias("repeated")))
    # the texts of candidates: one row for each text
    single = docs.select("doc_id", *text_keys(F.col("text")), "text").join(c, same, "left").where(F.col("m").isNull() | F.col("doc_id").eqNullSafe(F.col("one"))).select("k1", "k2", "text")
    texts = materialize(single.join(cand, ["k1", "k2"]).select("k1", "k2", "text", "repeated").dropDuplicates(["k1", "k2"]))
    rows = materialize(window_rows(texts, window))
    twice = materialize(rows.groupBy("h", "h2").count().where("count > 1").select("h", "h2"))
    hits = rows.join(twice, ["h", "h2"]).groupBy("k1", "k2").agg(F.collect_list("s").alias("starts"))

    def cut(batches):
        for batch in batches:
            n, sha, kept = [], [], []
            for t, s in zip(batch["text"], batch["starts"]):
                ws = words(_bytes(t))
                gone = covered(np.asarray(s.values, dtype=np.int64), len(ws), window)
                left = [x for x, y in zip(ws, gone.tolist()) if not y]
                n.append(len(ws) - len(left))
                sha.append(_sha(left))
                kept.append(b" ".join(left).decode() if with_text else "")
            yield pa.RecordBatch.from_arrays([batch["k1"], batch["k2"], pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.string())], ["h1", "h2", "gone", "sha", "kept"])

    done = materialize(texts.select("k1", "k2", "text").join(hits, ["k1", "k2"]).select("k1", "k2", "text", "starts").mapInArrow(cut, "h1 long, h2 long, gone long, sha string, kept string"))
    out = w.select("doc_id", "k1", "k2", "n_words", "whole").join(c, same, "left").join(done, (F.col("k1") == F.col("h1")) & (F.col("k2") == F.col("h2")), "left")
    full = F.col("m").isNotNull() & (F.col("n_words") >= window)
    out = out.select("doc_id", "k1", "k2", "n_words", F.when(full, F.col("n_words")).otherwise(F.coalesce("gone", F.lit(0))).cast("long").alias("n_removed"), F.when(full, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("sha", "whole")).alias("kept_sha256"), *([F.when(full, F.lit("")).otherwise(F.col("kept")).alias("kept")] if with_text else []))
    return out.drop("k1", "k2")


def op7(spark, sf_dir):
    """doc_id, n_words, n_removed, kept_sha256 of all documents, as remove_repeats() defines them."""
    from .common import documents

    return remove_repeats(documents(spark, sf_dir))


OP7_SQL = rf"""
with w as (select row_number() over () as r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
win as (select r, s, array_to_string(ws[s:s + {WINDOW - 1}], ' ') as k from (select r, ws, unnest(range(1, len(ws) - {WINDOW - 2})) as s from w where len(ws) >= {WINDOW})),
twice as (select k from win group by k having count(*) > 1),
gone as (select distinct r, unnest(range(s, s + {WINDOW})) as p from win where k in (select k from twice)),
word as (select r, unnest(ws) as x, generate_subscripts(ws, 1) as p from w),
kept as (select r, string_agg(x, ' ' order by p) as text, count(*) as n from word anti join gone using (r, p) group by r)
select doc_id, len(ws) as n_words, len(ws) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from w left join kept using (r)
"""
