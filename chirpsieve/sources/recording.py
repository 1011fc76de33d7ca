"""Recordings as a data source: `spark.read.format("recording")` and `df.write.format("recording")`.

A recording is a folder of Parquet files, one for each block of an observation,
and a manifest that names those that count. A file has a row group for every
`slice` samples, each with a row (chan, x) for every channel, so the end of a
block is read without the rest. Reading makes one input partition of each
block (or of several small ones), which also reads the samples before it (option `halo`) from the files of
the blocks before: block transforms need no shuffle. Filters on obs, block and
chan are pushed down. Writing adds files under new names and commits them in
the manifest at the end: what a failed or repeated task has left behind is
never named, and is deleted.
"""

from __future__ import annotations

import io
import re
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

MANIFEST = "_manifest.parquet"
SLICE = 1024
PARTITION = 1 << 25  # bytes of small blocks that are read by one task
KNOWN = pa.schema([("obs", pa.int64()), ("block", pa.int64()), ("file", pa.string()), ("samples", pa.int64()), ("channels", pa.int64())])
TESTS = {EqualTo: lambda a, b: a == b, In: lambda a, b: a in b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b}


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (pafs.LocalFileSystem(), path)


def manifest(path: str) -> list[dict]:
    """obs, block, file, samples, channels of each committed block, in order; none where nothing was committed."""
    fs, at = _store(path)
    if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.NotFound:
        return []
    with fs.open_input_file(f"{at}/{MANIFEST}") as f:
        return sorted(pq.read_table(f).to_pylist(), key=lambda r: (r["obs"], r["block"]))


@dataclass
class Block:
    """A block, and the files before it from which so many last samples are taken (lag, file, samples)."""

    obs: int
    block: int
    file: str
    before: list[tuple[int, str, int]]


class Blocks(InputPartition):
    """One block, or several small ones."""

    def __init__(self, blocks: list[Block]):
        super().__init__(None)
        self.blocks = blocks


def _samples(fs, file: str, last: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Channels, and the (channel, sample) matrix of a file; or of its last samples only, from as many row groups as hold them."""
    with fs.open_input_file(file) as f:
        p = pq.ParquetFile(f)
        parts, have, chan = [], 0, None
        for i in reversed(range(p.num_row_groups)):
            if last is not None and have >= last:
                break
            t = p.read_row_group(i).combine_chunks()
            chan = t["chan"].chunk(0).to_numpy()
            x = t["x"].chunk(0).flatten().to_numpy().reshape(len(chan), -1)
            parts.append(x)
            have += x.shape[1]
    m = np.concatenate(parts[::-1], axis=1)
    return chan, m if last is None else m[:, max(0, m.shape[1] - last) :]


class RecordingReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.halo, self.bytes = options["path"], int(options.get("halo", 0)), options.get("samples") == "bytes"
        self.tests: list[tuple[str, type, object]] = []

    def pushFilters(self, filters) -> Iterator:
        for f in filters:
            column = getattr(f, "attribute", None)
            if type(f) in TESTS and column in (("obs",), ("block",), ("chan",)) and getattr(f, "value", True) is not None:
                self.tests.append((column[0], type(f), f.value))
            else:
                yield f

    def _passes(self, **row) -> bool:
        return all(TESTS[kind](row[c], value) for c, kind, value in self.tests if c in row)

    def partitions(self) -> list[Blocks]:
        _, at = _store(self.path)
        known = manifest(self.path)
        by = {(r["obs"], r["block"]): r for r in known}
        out, size = [], PARTITION
        for r in known:
            if not self._passes(obs=r["obs"], block=r["block"]):
                continue
            need, k, before = self.halo, 1, []
            while need > 0 and (b := by.get((r["obs"], r["block"] - k))):
                before.append((k, f"{at}/{b['file']}", min(need, b["samples"])))
                need, k = need - b["samples"], k + 1
            mine = 4 * r["channels"] * r["samples"]
            if size + mine > PARTITION:
                out.append(Blocks([]))
                size = 0
            size += mine
            out[-1].blocks.append(Block(r["obs"], r["block"], f"{at}/{r['file']}", before))
        return out

    def read(self, partition: Blocks | None) -> Iterator[pa.RecordBatch]:
        for block in partition.blocks if partition else []:  # without a block Spark still reads once
            yield from self._read(block)

    def _read(self, block: Block) -> Iterator[pa.RecordBatch]:
        fs, _ = _store(self.path)
        for lag, file, last in [(0, block.file, None), *block.before]:
            chan, m = _samples(fs, file, last)
            keep = np.array([self._passes(chan=c) for c in chan.tolist()], dtype=bool) if any(c == "chan" for c, *_ in self.tests) else slice(None)
            chan, m = chan[keep], np.ascontiguousarray(m[keep])
            ends = np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]
            x = pa.Array.from_buffers(pa.binary(), len(m), [None, pa.py_buffer(ends * 4), pa.py_buffer(m)]) if self.bytes else pa.ListArray.from_arrays(pa.array(ends), pa.array(m.reshape(-1)))
            n = len(chan)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(n, block.obs)), pa.array(np.full(n, block.block)), pa.array(chan, pa.int32()), pa.array(np.full(n, lag, np.int32)), x], ["obs", "block", "chan", "lag", "x"])


@dataclass
class Written(WriterCommitMessage):
    blocks: list[dict]


class RecordingWriter(DataSourceArrowWriter):
    """Rows (obs, block, chan, x): all channels of a block must come to one task, as write_recording() has it."""

    def __init__(self, options: dict, overwrite: bool):
        self.path, self.slice, self.overwrite = options["path"], int(options.get("slice", SLICE)), overwrite
        fs, at = _store(self.path)
        fs.create_dir(at, recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, at = _store(self.path)
        done, held, key = [], [], None

        def close():
            t = pa.Table.from_batches(held).combine_chunks()
            chan = t["chan"].to_numpy()
            order = np.argsort(chan, kind="stable")
            size = np.diff(t["x"].combine_chunks().offsets.to_numpy()) if len(chan) else np.zeros(0)
            if len(set(chan.tolist())) != len(chan) or len(set(size.tolist())) != 1:
                raise ValueError(f"block {key[1]} of {key[0]}: every channel once, all of one length, is needed")
            m = t["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(len(chan), -1)[order]
            name = f"block-{key[0]}-{key[1]}-{uuid.uuid4().hex}.parquet"
            with fs.open_output_stream(f"{at}/{name}") as f, pq.ParquetWriter(f, pa.schema([("chan", pa.int32()), ("x", pa.list_(pa.float32()))]), compression="none", use_dictionary=False) as w:
                for a in range(0, m.shape[1], self.slice):
                    part = np.ascontiguousarray(m[:, a : a + self.slice])
                    x = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * part.shape[1]), pa.array(part.reshape(-1)))
                    w.write_table(pa.table({"chan": pa.array(chan[order].astype(np.int32)), "x": x}), row_group_size=len(m))
            done.append(dict(obs=key[0], block=key[1], file=name, samples=m.shape[1], channels=len(m)))

        for batch in iterator:
            o, b = batch["obs"].to_numpy(), batch["block"].to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(o) != 0) | (np.diff(b) != 0)) + 1).tolist(), len(o)]
            for i, j in zip(cuts, cuts[1:]):
                if i < j:
                    if held and (int(o[i]), int(b[i])) != key:
                        close()
                        held = []
                    key = (int(o[i]), int(b[i]))
                    held.append(batch.slice(i, j - i))
        if held:
            close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _store(self.path)
        known = [] if self.overwrite else manifest(self.path)
        known += [b for m in messages if m for b in m.blocks]
        if len({(r["obs"], r["block"]) for r in known}) != len(known):
            self.abort(messages)
            raise ValueError("a block is there twice: rows of one block must come to one task, and a block is appended once")
        out = io.BytesIO()
        pq.write_table(pa.Table.from_pylist(known, KNOWN), out)
        fresh = f"{at}/{MANIFEST}.{uuid.uuid4().hex}"
        with fs.open_output_stream(fresh) as f:
            f.write(out.getvalue())
        fs.move(fresh, f"{at}/{MANIFEST}")
        self._delete_but({r["file"] for r in known})

    def abort(self, messages: list[Written | None]) -> None:
        self._delete_but({r["file"] for r in manifest(self.path)})

    def _delete_but(self, named: set[str]) -> None:
        """Deletes the files of blocks that no manifest names: those of failed and repeated tasks."""
        fs, at = _store(self.path)
        for f in fs.get_file_info(pafs.FileSelector(at, allow_not_found=True)):
            if f.base_name.startswith("block-") and f.base_name not in named:
                fs.delete_file(f.path)


class Recording(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recording"

    def schema(self) -> str:
        return f"obs long, block long, chan int, lag int, x {'binary' if self.options.get('samples') == 'bytes' else 'array<float>'}"

    def reader(self, schema) -> RecordingReader:
        return RecordingReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> RecordingWriter:
        return RecordingWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known to a session, and lets Spark push filters into it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Recording)


def write_recording(packed: DataFrame, path: str, mode: str = "overwrite", slice: int = SLICE) -> None:
    """Writes rows (obs long, block long, chan, x) as a recording: one shuffle brings a block's channels together."""
    register(packed.sparkSession)
    n = int(packed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = packed.selectExpr("cast(obs as long) obs", "cast(block as long) block", "cast(chan as int) chan", "cast(0 as int) lag", "cast(x as array<float>) x")
    rows.repartition(n, "obs", "block").sortWithinPartitions("obs", "block").write.format("recording").mode(mode).option("slice", slice).save(path)


def read_recording(spark: SparkSession, path: str, halo: int = 0, as_bytes: bool = False) -> DataFrame:
    """obs, block, chan, lag, x: a partition for each block; rows of lag k > 0 are the samples that the halo needs from the k-th block before."""
    register(spark)
    return spark.read.format("recording").option("path", path).option("halo", halo).option("samples", "bytes" if as_bytes else "list").load()


def shared_folder(spark: SparkSession) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share; a local one only where Spark runs in one process."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="chirpsieve-")
    return f"{found.rstrip('/')}/recording-{uuid.uuid4().hex}"
