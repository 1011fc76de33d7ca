"""SimHash near-duplicates: fingerprints, candidate search by pigeonring filtering, components.

A 64-bit fingerprint has 8 segments of 8 bits. If two fingerprints differ in at
most t bits, then from some segment on, going round the ring, the differences
in the next l segments add up to at most l t / 8 for every l. For t = 3 those
budgets are 0, 0, 1, 1, 1, 2, 2, 3: two equal segments, and of the three that
follow at least two equal. So a join on four equal segments (24 choices, 32
bits each) meets every link, and the longer chains prune what it meets before
all 64 bits are counted. Only distinct fingerprints are joined, and of each
bucket only a spanning forest of its links is kept, so a group of n copies
makes n rows, not n^2.

Texts of Jaccard 0.8 differ in about 10 bits, and up to 27. Nothing finds all
pairs within 27 of 64 bits in less than all comparisons, so near_duplicates
takes its candidates from shared rare shingles, which lose nothing; there
chains of 128-bit fingerprints and the Hamming check prune pairs before whole
sets are compared.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER_AZ, boxed, lean, materialize, mix, slot, slots, text_keys
from .groups import STRIP, as_bytes, components, connected, shingle_set, whole_sets

SEGMENTS, BITS = 8, 8
PIECE = 50_000  # words hashed at a time
SMALL_RUN = 48  # buckets up to this size are compared pair by pair
CELLS = 18  # bits of a shingle's cell
SLICES = 16  # of the table of cells, while it is added up
FEW = 16  # sets below this size are compared without a look at their fingerprints
_BIT = np.arange(64, dtype=np.uint64)


def shingle_hashes(text: bytes, size: int):
    """XXH64 (seed 42) of the word shingles, piece by piece; words lower-cased in A-Z."""
    ws = text.translate(LOWER_AZ).split()
    h = xxhash.xxh64_intdigest
    if not ws:
        return
    if len(ws) <= size:
        yield np.array([h(b" ".join(ws), 42)], dtype=np.uint64)
        return
    for at in range(0, len(ws) - size + 1, PIECE):
        part = ws[at : at + PIECE + size - 1]
        rows = zip(*(part[i:] for i in range(size)))
        yield np.fromiter((h(b" ".join(r), 42) for r in rows), dtype=np.uint64, count=len(part) - size + 1)


def majority(ones: np.ndarray, n: int) -> int:
    """The fingerprint, as a signed long, of n hashes of which `ones` have each bit set."""
    fp = int(((ones * 2 > n).astype(np.uint64) << _BIT).sum()) if n else 0
    return fp - (1 << 64) * (fp >> 63)


def bit_counts(h: np.ndarray) -> np.ndarray:
    out = np.zeros(64, dtype=np.int64)
    for at in range(0, len(h), PIECE):
        out += np.unpackbits(h[at : at + PIECE].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return out


def fingerprint(text: bytes, size: int) -> int:
    """The fingerprint of all shingles, repeats included, as a signed long."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in shingle_hashes(text, size):
        ones += bit_counts(h)
        n += len(h)
    return majority(ones, n)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp of each row: null and empty texts have fingerprint 0. Other columns are ignored."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array([fingerprint(as_bytes(t), shingle) for t in batch["text"]], pa.int64())], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def budgets(most: int) -> list[int]:
    return [most * l // SEGMENTS for l in range(1, SEGMENTS + 1)]


def choices(most: int) -> list[tuple[int, tuple[int, ...]]]:
    """(first segment of the chain, segments that are equal): some choice holds for every link of at most `most` bits.

    Up to 3 bits by the chain's first five segments; up to 6, 8 - most segments
    are free of differences by the pigeonhole principle.
    """
    if most > 6:
        raise ValueError("the search is complete up to 6 bits only")
    if most <= 3:
        return [(i, tuple((i + j) % SEGMENTS for j in (0, 1, *two))) for i in range(SEGMENTS) for two in combinations((2, 3, 4), 2)]
    return [(-1, c) for c in combinations(range(SEGMENTS), SEGMENTS - most)]


def keys(fp: Column, most: int) -> Column:
    """An array of bucket keys, one for each choice of equal segments."""
    out = []
    for _, segs in choices(most):
        key = F.lit(len(out)).cast("long")
        for s in segs:
            key = F.shiftleft(key, BITS).bitwiseOR(F.shiftrightunsigned(fp, BITS * s).bitwiseAND(F.lit(255)))
        out.append(key)
    return F.array(*out)


def close(a: np.ndarray, b: np.ndarray, most: int, start: np.ndarray | int) -> np.ndarray:
    """Whether pairs are links: the chain from `start` within its budgets, then all 64 bits."""
    x = a ^ b
    ok = np.ones(x.shape, dtype=bool)
    if most <= 3:
        bud = budgets(most)
        for l in (5, 7):
            mask = _MASKS[l][start]
            ok &= np.bitwise_count(x & mask) <= bud[l - 1]
    if ok.any():
        ok &= np.bitwise_count(x) <= most
    return ok


_MASKS = {l: np.array([sum(255 << (BITS * ((s + j) % SEGMENTS)) for j in range(l)) for s in range(SEGMENTS)], dtype=np.uint64) for l in (5, 7)}


def bucket_forest(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """A minimum spanning forest (positions) of the links within one bucket of distinct fingerprints.

    Up to 4,096 by Prim's method; beyond, the bucket is cut by further equal
    quarters of the bits that still vary (of `most` < 4 differences one quarter
    at least is free), so no step holds a matrix.
    """
    n = len(fps)
    if n > 4096 and most < 4:
        vary = np.bitwise_or.reduce(fps ^ fps[0])
        bits = [b for b in range(64) if int(vary) >> b & 1]
        if len(bits) >= 8:
            us, vs = [], []
            for q in range(4):
                mask = np.uint64(sum(1 << b for b in bits[q::4]))
                order = np.argsort(fps & mask, kind="stable")
                cut = np.flatnonzero(np.diff((fps & mask)[order])) + 1
                for part in np.split(order, cut):
                    if len(part) > 1:
                        u, v = bucket_forest(fps[part], most)
                        us.append(part[u])
                        vs.append(part[v])
            return (np.concatenate(us), np.concatenate(vs)) if us else (np.zeros(0, int), np.zeros(0, int))
    best, near, left = np.full(n, 65, dtype=np.int64), np.zeros(n, dtype=np.int64), np.ones(n, dtype=bool)
    us, vs = [], []
    for _ in range(n):
        i = int(np.argmin(np.where(left, best, 66)))
        if best[i] <= most:
            us.append(near[i])
            vs.append(i)
        left[i] = False
        d = np.bitwise_count(fps ^ fps[i]).astype(np.int64)
        closer = left & (d < best)
        best[closer], near[closer] = d[closer], i
    return np.array(us, dtype=np.int64), np.array(vs, dtype=np.int64)


def links(nodes: DataFrame, most: int) -> DataFrame:
    """Distinct (u, v), u < v: links between rows (node, fp) with at most `most` (6 at most) differing bits, enough to connect them.

    Buckets over SMALL_RUN make a spanning forest, others all their links:
    either way a bucket of n rows makes fewer than n SMALL_RUN links, and the
    components are those of all links.
    """
    starts = np.array([max(0, s) for s, _ in choices(most)])

    def pairs(key, fp, node):
        us, vs = [], []
        cut = np.flatnonzero(np.diff(key)) + 1
        begin, end = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
        size = np.repeat(end - begin, end - begin)
        nseg = len(choices(most)[0][1])
        small = size <= SMALL_RUN
        # the key has the number of its choice above the segments
        start = starts[(key >> (BITS * nseg)).astype(np.int64)]
        for d in range(1, min(SMALL_RUN, len(key))):
            at = np.flatnonzero((key[d:] == key[:-d]) & small[d:])
            if not len(at):
                break
            at = at[close(fp[at], fp[at + d], most, start[at])]
            us.append(node[at])
            vs.append(node[at + d])
        for b, e in zip(begin[end - begin > SMALL_RUN], end[end - begin > SMALL_RUN]):
            u, v = bucket_forest(fp[b:e], most)
            us.append(node[b:e][u])
            vs.append(node[b:e][v])
        u, v = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (us, vs))
        return np.minimum(u, v), np.maximum(u, v)

    def run(batches):
        held = None
        for batch in batches:
            now = [batch["key"].to_numpy(), batch["fp"].to_numpy().view(np.uint64), batch["node"].to_numpy()]
            if not len(now[0]):
                continue
            if held is not None:
                now = [np.concatenate(x) for x in zip(held, now)]
            last = int(np.searchsorted(now[0], now[0][-1]))
            held = [x[last:] for x in now]
            if last:
                u, v = pairs(*(x[:last] for x in now))
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])
        if held is not None:
            u, v = pairs(*held)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], ["u", "v"])

    rows = nodes.select("node", "fp", F.explode(keys(F.col("fp"), most)).alias("key"))
    found = rows.repartition("key").sortWithinPartitions("key", "fp", "node").mapInArrow(run, "u long, v long")
    return found.where("u <> v").distinct()


def similar(docs: DataFrame, shingle: int = 3, most: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row.

    Null and empty texts have fingerprint 0 and link like any other. A null
    doc_id keeps its row; component_id is the smallest doc_id that is not null
    (null if there is none). Repeated rows stay. Other columns are ignored.
    """
    w = materialize(fingerprints(docs, shingle))
    least = w.groupBy("fp").agg(F.min("doc_id").alias("least"))
    label = components(links(w.select(F.col("fp").alias("node"), "fp").distinct(), most))
    by = least.join(label, least.fp == label.node, "left").select("fp", "least", F.coalesce("label", "fp").alias("label"))
    by = materialize(by)
    of = by.groupBy("label").agg(F.min("least").alias("component_id"))
    final = by.join(of, "label").select("fp", "component_id")
    return w.join(final, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3(spark, sf_dir):
    """doc_id, fingerprint, component_id of all documents, as similar() defines them."""
    from .common import documents

    return similar(documents(spark, sf_dir))


def commonness(texts: DataFrame, shingle: int) -> np.ndarray:
    """For each of 2^CELLS cells of shingle hashes, how often it is met in all texts, 0 unless it stands out.

    It only orders shingles, rare ones first: any table gives the same links, a
    good one fewer comparisons. A shingle stands out once it is met some times
    the square root of a cell's mean. The table's size is fixed: each task adds
    up its own, and slices of these are added up.
    """
    width = (1 << CELLS) // SLICES

    def count(batches):
        table = np.zeros(1 << CELLS, dtype=np.int32)
        for batch in batches:
            cells, held = [], 0
            for t in batch["text"]:
                cells.append((shingle_set(as_bytes(t), shingle) >> np.uint64(64 - CELLS)).astype(np.int32))
                held += len(cells[-1])
                if held > 1 << CELLS:
                    table += np.bincount(np.concatenate(cells), minlength=1 << CELLS).astype(np.int32)
                    cells, held = [], 0
            if held:
                table += np.bincount(np.concatenate(cells), minlength=1 << CELLS).astype(np.int32)
        if table.any():
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(SLICES, dtype=np.int32)), pa.array([x.tobytes() for x in table.reshape(SLICES, width)], pa.binary())], ["slice", "met"])

    def add(batches):
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch["slice"].to_pylist(), batch["met"]):
                total[k] = total.get(k, np.zeros(width, dtype=np.int64)) + np.frombuffer(x.as_buffer(), np.int32)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["slice", "met"])

    rows = texts.select("text").mapInArrow(lean(count), "slice int, met binary").repartition(SLICES, "slice").mapInArrow(lean(add), "slice int, met binary")
    table = np.zeros((SLICES, width), dtype=np.int64)
    for r in materialize(rows).collect():  # SLICES rows of a fixed size
        table[r.slice] = np.frombuffer(r.met, np.int64)
    mean = table.mean()
    return np.where(table > mean + 6 * mean**0.5 + 4, table, 0).ravel()


def survey(docs: DataFrame, shingle: int, similarity: float, common: np.ndarray) -> DataFrame:
    """doc_id, k1, k2 (keys of the text), c1, c2 (key of its shingle set), n (its size), fp, fp2, prefix (its rarest shingles) of each row.

    fp and fp2 are the 128-bit fingerprint of the distinct shingles. Sets of Jaccard `similarity`
    or more have a shingle in common among the first n - similarity n + 1 of
    each, in whatever order all sets share.
    """
    table = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches):
        cells = table.value
        for batch in batches:
            c, n, fp, out = [], [], [], []
            for t in batch["text"]:
                h = shingle_set(as_bytes(t), shingle)
                size = len(h)
                first = size - int(np.ceil(similarity * size - 1e-9)) + 1
                c.append(np.frombuffer(xxhash.xxh3_128_digest(h.tobytes()), np.int64))
                n.append(size)
                fp.append(wide_fingerprint(h))
                # sets without shingles share one that none has
                out.append(h[np.argsort(cells[h >> np.uint64(64 - CELLS)], kind="stable")[:first]] if size else np.zeros(1, np.uint64))
            ends = np.concatenate([[0], np.cumsum([len(x) for x in out])]).astype(np.int32)
            prefix = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*out, np.zeros(0, np.uint64)]).view(np.int64)))
            c, fp = np.array(c, dtype=np.int64).reshape(-1, 2), np.array(fp, dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["k1"], batch["k2"], pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array(n, pa.int32()), pa.array(fp[:, 0]), pa.array(fp[:, 1]), prefix], ["doc_id", "k1", "k2", "c1", "c2", "n", "fp", "fp2", "prefix"])

    return docs.select("doc_id", *text_keys(F.col("text")), "text").mapInArrow(lean(run), "doc_id long, k1 long, k2 long, c1 long, c2 long, n int, fp long, fp2 long, prefix array<long>")


def reach(similarity: float, bits: int = 128) -> int:
    """Bits in which fingerprints of sets of Jaccard `similarity` may differ: mean and six standard deviations."""
    p = np.arccos(2 * similarity / (1 + similarity)) / np.pi
    return int(np.ceil(bits * p + 6 * (bits * p * (1 - p)) ** 0.5))


def wide_fingerprint(h: np.ndarray) -> list[int]:
    """128 bits as two signed longs: fingerprints of distinct hashes and of the same hashes mixed."""
    return [majority(bit_counts(h), len(h)), majority(bit_counts(mix(h)), len(h))]


def partners(n: np.ndarray, fp: np.ndarray, similarity: float) -> np.ndarray:
    """Which pairs of sets (sizes, 128-bit fingerprints as rows of two) may be alike: sizes, then chains, then all bits.

    Fingerprints of very small sets vary too much: those pass on their sizes.
    """
    most, m = reach(similarity), len(n)
    rings = 2 * SEGMENTS
    out = np.zeros((m, m), dtype=bool)
    for at in range(0, m, STRIP):
        a = slice(at, at + STRIP)
        low, high = np.minimum(n[a, None], n[None, :]), np.maximum(n[a, None], n[None, :])
        ok = low >= similarity * high - 1e-9
        segments = np.bitwise_count((fp[a, None] ^ fp[None, :]).view(np.uint8).reshape(*ok.shape, rings))
        chain, spent = np.ones(segments.shape, dtype=bool), np.zeros(segments.shape, dtype=np.uint8)
        for l in range(3):
            spent = spent + np.roll(segments, -l, axis=2)
            chain &= spent <= most * (l + 1) / rings
        pairs = np.nonzero(ok & (low >= FEW))
        ok[pairs] = chain.any(axis=2)[pairs]
        ok &= (low < FEW) | (segments.sum(axis=2, dtype=np.int64) <= most)
        out[a] = ok
    np.fill_diagonal(out, False)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, k1, k2 (keys of the text), times (rows equal in these), keep for each of docs' rows: of each group of documents whose shingle sets have Jaccard `similarity` at least, one is kept.

    Repeated rows are one row; an empty table has none. Groups are the components of all pairs of distinct sets that are alike.
    Candidates are sets that share a shingle of their prefixes (exact: no pair
    is missed). Within each candidate group, pairs go that can't be alike by size
    or by their fingerprints' chains and Hamming distance; sets that hang
    together by the others are compared in whole, in blocks. A group keeps the row with the smallest (doc_id, k1,
    k2), nulls last. Null and empty texts are one group.
    """
    w = materialize(survey(docs, shingle, similarity, commonness(docs, shingle)))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k1", "k2")).alias("first")
    sets = w.groupBy("c1", "c2").agg(first, *[F.first(c).alias(c) for c in ("n", "fp", "fp2", "prefix")])
    sets = materialize(sets.drop("c1", "c2")).withColumn("node", F.monotonically_increasing_id())
    # the numbers of rows are those of the written files: written once more, without the prefixes, they stay
    nodes = materialize(sets.drop("prefix"))
    rows = sets.select("node", F.explode("prefix").alias("key"))
    again = materialize(rows.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("m")).where("m > 1").select("key", "hub"))
    groups = materialize(rows.join(again, "key").select("hub", "node").distinct())

    each = materialize(w.groupBy("doc_id", "k1", "k2").agg(F.count(F.lit(1)).alias("times")))
    repeated = not each.where("times > 1").isEmpty()

    def probable(n, fp, fp2):
        return partners(n, np.stack([fp, fp2], axis=1).astype(np.int64), similarity)

    def whole(some):
        return whole_sets(docs, nodes.join(some, "node"), shingle, repeated)

    label = connected(groups, nodes.select("node", "n", "fp", "fp2"), whole, probable, similarity)
    per = nodes.select("node", "first").join(label.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left")
    best = per.groupBy(F.coalesce("label", "node").alias("label")).agg(F.min("first").alias("best"))
    best = best.select(F.col("best.doc_id").alias("b_id"), F.col("best.k1").alias("b1"), F.col("best.k2").alias("b2"))
    same = F.col("doc_id").eqNullSafe(F.col("b_id")) & (F.col("k1") == F.col("b1")) & (F.col("k2") == F.col("b2"))
    return each.join(best, same, "left").select("doc_id", "k1", "k2", "times", F.col("b1").isNotNull().alias("keep"))


def dedup(docs: DataFrame, **how) -> DataFrame:
    """docs without all but one row of each group of near-duplicates; columns as they are, whatever their names.

    Of rows equal in doc_id and text one stays. An empty table stays empty. Only
    rows that may have to go are shuffled.
    """
    marks = materialize(near_duplicates(docs, **how))
    k1, k2 = text_keys(F.col("text"))
    d = boxed(docs, id=F.col("doc_id"), k1=k1, k2=k2).join(slots(marks.where("not keep or times > 1")), slot() == F.col("slot_"), "left")
    keep = marks.where("keep").select(F.col("doc_id").alias("id_"), F.col("k1").alias("n1_"), F.col("k2").alias("n2_"), "times")
    same = F.col("id").eqNullSafe(F.col("id_")) & (F.col("k1") == F.col("n1_")) & (F.col("k2") == F.col("n2_"))
    open_ = d.where("slot_ is not null").join(keep, same)
    if not keep.where("times > 1").isEmpty():
        one = open_.where("times = 1").select("row")
        open_ = one.union(open_.where("times > 1").dropDuplicates(["id", "k1", "k2"]).select("row"))
    return d.where("slot_ is null").select("row").union(open_.select("row")).select("row.*")
