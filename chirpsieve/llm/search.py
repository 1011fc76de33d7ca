"""Ranked lexical search by hashed max-sketches.

The index holds, for each document, its terms (64-bit hashes) with their
counts, and a sketch: terms fall into BUCKETS by their hash, and a bucket keeps
its largest count. A term's impact grows with its count, so a bucket's impact is
the largest that any of its terms has. Queries are looked up in batches: the
sketches' impacts times the queries' weights in each bucket, one matrix
product, are upper bounds for all documents and queries at once. Each task
scores documents exactly in descending order of their bounds, until a bound is
below the k-th best score that it has; the tasks' best are ranked at the end.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import documents, materialize
from .groups import as_bytes

# A term is a run of ASCII letters, digits and characters beyond ASCII; A-Z are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
BEST = 50
BUCKETS = 1024
FULL = 255  # a bucket's count from here on is unknown: its impact is taken as IMPACT
IMPACT = 1_000_000  # no impact reaches it
QUERIES, QUERY_TERMS = 1024, 1 << 20  # queries of a batch, and their terms: bounds what is broadcast
ROWS, STEP = 512, 64  # documents bounded, and scored, at a time

_TERMS = np.full(256, 32, dtype=np.uint8)
for _low, _high in ((48, 58), (97, 123), (128, 256)):
    _TERMS[_low:_high] = np.arange(_low, _high)
_TERMS[65:91] = np.arange(97, 123)
_TERMS = _TERMS.tobytes()


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


def hashed(distinct) -> np.ndarray:
    h = xxhash.xxh64_intdigest
    return np.fromiter((h(t) for t in distinct), dtype=np.uint64, count=len(distinct))


def bucket(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def length_norm(n, documents: int, length: int):
    return 50 + 50 * n * documents // length


def impact(count, norm):
    """Grows with the count, for any norm."""
    return 1_000_000_000 * count // (1000 * count + 20 * norm)


def index(docs: DataFrame) -> DataFrame:
    """doc_id, n, terms, counts, sketch of each row of docs (doc_id long, text) that has a term.

    Null texts and texts without terms have none; every other row is a document,
    repeated or not; long texts are read whole. Terms are known by 64 bits of
    hash: two of 10^9 terms of a corpus and 10^4 of a query are one with a
    chance of 10^-6.
    """
    names = ["doc_id", "n", "terms", "counts", "sketch"]

    def run(batches):
        for batch in batches:
            out = []
            for i, text in enumerate(batch.column(1)):
                found = Counter(terms(as_bytes(text)))
                if found:
                    h, c = hashed(found), np.fromiter(found.values(), dtype=np.uint32, count=len(found))
                    order = np.argsort(h)
                    h, c = h[order], c[order]
                    sketch = np.zeros(BUCKETS, dtype=np.uint8)
                    np.maximum.at(sketch, bucket(h), np.minimum(c, FULL).astype(np.uint8))
                    out.append((i, int(c.sum()), h.tobytes(), c.tobytes(), sketch.tobytes()))
            at, *cols = zip(*out) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *(pa.array(x, k) for x, k in zip(cols, (pa.int64(), *[pa.binary()] * 3)))], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n long, terms binary, counts binary, sketch binary")


def _joined(column, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary column side by side, and how many each row has."""
    parts = [np.frombuffer(as_bytes(x), dtype=dtype) for x in column]
    return np.concatenate(parts) if parts else np.zeros(0, dtype), np.array([len(x) for x in parts], dtype=np.int64)


def _known(vocabulary: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in h of a vocabulary's terms, and their numbers in it."""
    at = np.minimum(np.searchsorted(vocabulary, h), max(0, len(vocabulary) - 1))
    hit = np.flatnonzero(vocabulary[at] == h) if len(vocabulary) else np.zeros(0, np.int64)
    return hit, at[hit]


def statistics(indexed: DataFrame, vocabulary: np.ndarray) -> tuple[int, int, np.ndarray]:
    """Documents with a term, terms of all of them, and how many documents hold each term of a vocabulary."""
    shared = indexed.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        v, total = shared.value, np.zeros(len(shared.value) + 2, dtype=np.int64)
        for batch in batches:
            h, _ = _joined(batch["terms"], np.uint64)
            total[2:] += np.bincount(_known(v, h)[1], minlength=len(v))
            total[:2] += batch.num_rows, sum(batch["n"].to_pylist())
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "n"])

    got = indexed.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(len(vocabulary) + 2, dtype=np.int64)
    for r in got:
        total[r.term] = r.n
    return int(total[0]), int(total[1]), total[2:]


class Best:
    """The k best (score, key) of one query: highest scores, then smallest keys, null keys last."""

    def __init__(self, k: int):
        self.k, self.score, self.key, self.null = k, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, score: np.ndarray, key: np.ndarray, null: np.ndarray) -> None:
        some = score > 0
        score, key, null = (np.concatenate([a, b[some]]) for a, b in ((self.score, score), (self.key, key), (self.null, null)))
        order = np.lexsort((key, null, -score))[: self.k]
        self.score, self.key, self.null = score[order], key[order], null[order]

    @property
    def least(self) -> int:
        """A score below this one changes nothing."""
        return int(self.score[-1]) if len(self.score) == self.k else 1


def _rank(indexed: DataFrame, batch_of: dict, k: int, item: str) -> DataFrame:
    """query, item_id, doc_id, score: the best k of each task for each query of a batch."""
    shared = indexed.sparkSession.sparkContext.broadcast(batch_of)

    def run(batches):
        q = shared.value
        vocabulary, weight, of = q["vocabulary"], q["weight"], q["terms"]
        lookup = np.zeros((BUCKETS, len(of)))
        for i, t in enumerate(of):
            np.add.at(lookup[:, i], bucket(vocabulary[t]), weight[t])
        best = [Best(k) for _ in of]
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                ids = part["doc_id"]
                null, key = np.array(ids.is_null()), np.array(ids.fill_null(0), dtype=np.int64)
                norm = length_norm(part["n"].to_numpy(), q["documents"], q["length"])
                peak = np.frombuffer(b"".join(map(as_bytes, part["sketch"])), dtype=np.uint8).reshape(len(key), BUCKETS).astype(np.int64)
                bound = np.where(peak < FULL, impact(peak, norm[:, None]), IMPACT).astype(np.float64) @ lookup
                bound = bound * (1 + 1e-9)  # sums beyond 2^53 are rounded
                h, size = _joined(part["terms"], np.uint64)
                count = _joined(part["counts"], np.uint32)[0].astype(np.int64)
                hit, term = _known(vocabulary, h)
                row = np.repeat(np.arange(len(key)), size)[hit]
                cell, value = row * len(vocabulary) + term, impact(count[hit], norm[row])  # cells ascend: so do a row's hashes
                least = np.array([b.least for b in best])
                for i in np.flatnonzero((bound >= least).any(0)).tolist():
                    mine = np.flatnonzero(bound[:, i] >= best[i].least)
                    mine = mine[np.argsort(-bound[mine, i], kind="stable")]
                    for first in range(0, len(mine), STEP):
                        rows = mine[first : first + STEP]
                        if bound[rows[0], i] < best[i].least:
                            break
                        want = (rows[:, None] * len(vocabulary) + of[i]).ravel()
                        where = np.minimum(np.searchsorted(cell, want), max(0, len(cell) - 1))
                        got = np.where(cell[where] == want, value[where], 0) if len(cell) else np.zeros(len(want), np.int64)
                        best[i].add((got.reshape(len(rows), -1) * weight[of[i]]).sum(1), key[rows], null[rows])
        for i, b in enumerate(best):
            if len(b.score):
                ids = pa.array(b.key, pa.int64(), mask=b.null)
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(ids), pa.int32()), pa.array([q["items"][i]] * len(ids), q["kind"]), ids, pa.array(b.score)], ["query", "item_id", "doc_id", "score"])

    return indexed.mapInArrow(run, f"query int, item_id {item}, doc_id long, score long")


def search(indexed: DataFrame, queries: DataFrame, k: int = BEST) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of queries (item_id, text) the k documents of the highest score above 0.

    A query's terms count once each; equal scores go by ascending doc_id, nulls
    last. Each row of queries is one query, also where item_id is null or
    repeated; queries without terms have no rows, and no documents give none.
    Queries are taken in batches of about QUERIES rows and QUERY_TERMS terms, of
    which only numbers and hashes are broadcast; each batch reads the index twice.
    """
    spark, kind = queries.sparkSession, queries.schema["item_id"].dataType.simpleString()

    def tokenised(batches):
        for batch in batches:
            found = [hashed(sorted(set(terms(as_bytes(t))))) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x.tobytes() for x in found], pa.binary()), pa.array([len(x) for x in found], pa.int64())], ["item_id", "terms", "n"])

    asked = materialize(queries.select("item_id", "text").mapInArrow(tokenised, f"item_id {kind}, terms binary, n long").where("n > 0"))
    size = asked.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    batches = max(1, -(-size[0] // QUERIES), -(-size[1] // QUERY_TERMS))
    dealt, out = F.pmod(F.xxhash64("item_id", "terms"), F.lit(batches)), None
    for b in range(batches):
        rows = asked.where(dealt == b).orderBy("item_id", "terms").toArrow()
        if not rows.num_rows:
            continue
        of = [np.frombuffer(as_bytes(x), np.uint64) for x in rows["terms"]]
        vocabulary = np.unique(np.concatenate(of))
        n, length, df = statistics(indexed, vocabulary)
        if not n:
            break
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * d + 1))) for d in df.tolist()], dtype=np.int64)
        q = {"vocabulary": vocabulary, "weight": weight, "terms": [np.sort(np.searchsorted(vocabulary, x)) for x in of], "items": rows["item_id"].to_pylist(), "kind": rows.schema.field("item_id").type, "documents": n, "length": length}
        part = _rank(indexed, q, k, kind).withColumn("batch", F.lit(b))
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {kind}, rank int, doc_id long, score long")
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    # every task sends k rows a query: they are ranked in groups first, so that no task gets them all
    for by in (["batch", "query", F.col("doc_id") % 64], ["batch", "query"]):
        out = out.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)
    return out.select("item_id", "rank", "doc_id", "score")


def op13(spark, sf_dir):
    """item_id, rank, doc_id, score: the 50 best documents of `documents` for each item of `benchmark`."""
    return search(materialize(index(documents(spark, sf_dir))), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP13_SQL = r"""
with tokens as (select rowid_ as row_, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from (select row_number() over () as rowid_, doc_id, text from documents)),
n as (select row_, doc_id, count(*) as n from tokens group by 1, 2),
total as (select count(*) as docs, cast(sum(n) as bigint) as len from n),
df as (select term, count(distinct row_) as df from tokens group by 1),
asked as (select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term from benchmark),
w as (select item_id, asked.term, cast(floor(1000 * ln((2 * docs + 2) / (2 * df + 1))) as bigint) as w from asked join df on df.term = asked.term, total),
tf as (select row_, term, count(*) as tf from tokens where term in (select term from asked) group by 1, 2),
scored as (select item_id, n.row_, n.doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n.n * docs) // len)))) as bigint) as score from w join tf on tf.term = w.term join n on n.row_ = tf.row_, total group by 1, 2, 3)
select item_id, cast(rank as integer) as rank, doc_id, score from (select item_id, doc_id, score, row_number() over (partition by item_id order by score desc, doc_id nulls last) as rank from scored where score > 0) where rank <= 50"""
