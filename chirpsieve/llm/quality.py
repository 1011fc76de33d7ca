"""Quality classifier: nearest-neighbour voting in a latent-semantic space.

A document's terms are its words (hashed), the three-grams of its byte classes,
and the pair of a word with itself; each counts by the root of its share.
Labelled documents (a bounded sample) give the terms' weights, a truncated SVD
and the vectors to vote; these are broadcast (at most SAMPLE x DIMENSIONS
floats a class), and every document is compared with all of them in blocks.
Terms and constants were chosen by cross-validation on rows that aren't held
out, and on those alone.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, lean, words

CLASSES, WORDS = 12, 1024
WORD_WEIGHT = 0.5  # beside byte classes, which tell more
SAMPLE = 1500  # labelled documents of each class at most
DIMENSIONS, NEIGHBOURS, SHARPNESS = 48, 15, 8
THRESHOLD = 0.7
PIECE = 1 << 20

# Byte classes.
_CLASS = np.full(256, 10, dtype=np.int64)
for _i, _chars in enumerate([b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" \t", b"\n\r\x0b\x0c", bytes(range(128, 256)), b".,;:", b"!?", b"|", b"%&$#*"]):
    _CLASS[list(_chars)] = _i
TERMS = CLASSES**3 + 1 + WORDS


def terms(text: bytes) -> np.ndarray:
    """Roots of the shares of all terms in a whole text, float32."""
    classes = np.zeros(CLASSES**3)
    for at in range(0, len(text), PIECE):
        c = _CLASS[np.frombuffer(text[max(0, at - 2) : at + PIECE], dtype=np.uint8)]
        if len(c) > 2:
            classes += np.bincount((c[:-2] * CLASSES + c[1:-1]) * CLASSES + c[2:], minlength=CLASSES**3)
    ws = words(text)
    hashed = np.fromiter(map(zlib.crc32, words(text.translate(LOWER_AZ))), dtype=np.int64, count=len(ws)) % WORDS
    counts = np.bincount(hashed, minlength=WORDS)
    twice = sum(map(bytes.__eq__, ws[1:], ws))
    n = max(1, len(ws))
    return np.concatenate([np.sqrt(classes / max(1, len(text))), [(twice / n) ** 0.5], WORD_WEIGHT * np.sqrt(counts / n)]).astype(np.float32)


def _matrix(column) -> np.ndarray:
    return np.stack([terms(t.as_buffer().to_pybytes() if t.is_valid and t.as_buffer() is not None else b"") for t in column]) if len(column) else np.zeros((0, TERMS), np.float32)


def held_out(doc_id="doc_id"):
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2


def training_rows(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """Term rows and labels of at most `sample` documents a class, those of the smallest hash of doc_id.

    A document whose labels contradict each other is left out; of several rows
    with one doc_id that of the smallest text hash is taken, so reruns agree.
    """
    spark, picked = docs.sparkSession, None
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("q2"))
    known = known.where("quality = q2").where(~held_out()).withColumn("h_", F.xxhash64("doc_id"))
    for mark in (0, 1):
        part = known.where(F.col("quality") == mark).orderBy("h_", "doc_id").limit(sample)
        picked = part if picked is None else picked.union(part)
    ids = picked.select("doc_id", "quality").toPandas()
    side = F.broadcast(spark.createDataFrame(list(map(tuple, ids.astype("int64").values.tolist())), "id_ long, quality_ int"))

    def run(batches):
        for batch in batches:
            m = _matrix(batch["text"])
            yield pa.RecordBatch.from_arrays([batch["quality_"], batch["doc_id"], batch["k_"], pa.array([r.tobytes() for r in m], pa.binary())], ["y", "id", "k", "x"])

    found = docs.select("doc_id", "text").join(side, F.col("doc_id") == F.col("id_")).select("quality_", "doc_id", F.xxhash64("text").alias("k_"), "text").mapInArrow(lean(run), "y int, id long, k long, x binary")
    got = found.groupBy("id").agg(F.min(F.struct("k", "x", "y")).alias("r")).select("id", "r.x", "r.y").orderBy("id")
    # sample rows a class at most; one partition's rows at a time, so that no second copy of all is held
    rows, y = np.zeros((ids.shape[0], TERMS), np.float32), np.zeros(ids.shape[0], np.float32)
    n = 0
    for r in got.toLocalIterator():
        rows[n], y[n] = np.frombuffer(r.x, np.float32), r.y
        n += 1
    return rows[:n], y[:n]


def basis_of(x: np.ndarray, dimensions: int, rounds: int = 6) -> np.ndarray:
    """The leading right singular vectors of x, by seeded subspace iteration."""
    k = min(dimensions, *x.shape)
    q = np.random.default_rng(0).standard_normal((x.shape[1], min(k + 16, *x.shape))).astype(x.dtype)
    for _ in range(rounds):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, vectors = np.linalg.eigh((x @ q).T @ (x @ q))
    return (q @ vectors[:, ::-1])[:, :k]


def fit(rows: np.ndarray, y: np.ndarray, dimensions: int = DIMENSIONS) -> dict:
    """Inverse document frequencies, the SVD's basis, and the labelled vectors."""
    seen = (rows > 0).sum(0)
    idf = np.where(seen > 0, np.log((1 + len(rows)) / (1 + seen)) + 1, 0).astype(np.float32)
    x = rows * idf
    x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
    basis = np.zeros((rows.shape[1], 1)) if not len(rows) else basis_of(x, dimensions)
    z = x @ basis
    z /= np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)
    return {"map": (idf[:, None] * basis).astype(np.float32), "z": z.astype(np.float32), "y": y}


def vote(model: dict, rows: np.ndarray, neighbours: int = NEIGHBOURS) -> np.ndarray:
    """Score of each row: labels of its nearest labelled vectors, weighted by a power of the cosine.

    Without labelled rows every score is 0.5. Ties fall to the earlier labelled row.
    """
    z, y = model["z"], model["y"]
    if not len(z):
        return np.full(len(rows), 0.5)
    q = rows @ model["map"]
    q /= np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-9)
    s = q @ z.T
    k = min(neighbours, len(z))
    top = np.argpartition(-s, k - 1, axis=1)[:, :k]
    w = np.maximum(np.take_along_axis(s, top, 1), 0).astype(np.float64) ** SHARPNESS + 1e-9
    return (w * y[top]).sum(1) / w.sum(1)


def score(docs: DataFrame, model: dict, columns: list[str]) -> DataFrame:
    """columns + score for each row of docs; nothing but the text is looked at. Null text scores as an empty one; a column `score` raises."""
    if "score" in columns:
        raise ValueError("score is made here: rename the column of docs")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)

    def run(batches):
        m = shared.value
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 256):
                out.append(vote(m, _matrix(batch["text"].slice(at, 256))))
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in columns), pa.array(np.clip(np.concatenate(out), 0, 1) if out else [], pa.float64())], [*columns, "score"])

    names = list(dict.fromkeys([*columns, "text"]))
    return docs.select(*names).mapInArrow(lean(run), f"{kinds}, score double")


def classify(docs: DataFrame, labels: DataFrame, columns: list[str]) -> DataFrame:
    """columns + score of each row of docs, learned from labels (doc_id, quality) of rows that aren't held out.

    Null and empty texts get a score like any other; without labels all are
    0.5; repeated rows score alike; an empty table stays empty. A column `score`
    among those kept raises.
    """
    return score(docs, fit(*training_rows(docs, labels)), columns)


def op4(spark, sf_dir):
    """doc_id, held_out, score, predicted of all documents, as classify() scores them."""
    from .common import documents

    d = classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), ["doc_id"])
    return d.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
