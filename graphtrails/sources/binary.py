"""Binary formats: readers by byte range over an index of record starts, and a sink that commits by manifest.

Records have variable length and no sync mark. A pass over the heads alone finds a record start every
``RANGE_BYTES`` of a longer file, and cuts the list of a longer record; the ranges are then decoded apart, as
arrays. Fixed records (vertex maps) are read by byte range at once. The tables of files and ranges are a few bytes,
so their rows are dealt to a fixed number of tasks: adaptive execution would bring them all into one.

The sink deals rows to files by the running sum of their bytes, so a vertex with very many neighbours fills several
files. A file whose first record goes on with a vertex says so in its name: ``-c<records before>x<longest list>``.
"""

from __future__ import annotations

import csv
import io
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage
from pyspark.sql.types import StructType

from graphtrails.functions.graph import PART_SHIFT, VERTEX_MASK, pack_remote
from graphtrails.operators.ranks import prefix_sum
from graphtrails.operators.skew import GROUP_ROWS
from graphtrails.scratch import Scratch
from graphtrails.sources.text import remote_map

RANGE_BYTES = 16 << 20
MAP_RECORD = 16
#: Bytes read ahead while heads are looked for.
_AHEAD = 1 << 20
_GOES_ON = re.compile(r"-c(\d+)x(\d+)\.bin$")

def _open(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path[len("file:"):]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


MANIFEST = "_manifest"
_MANIFEST_SCHEMA = "file string, vertices long, edges long, bytes long"


def _files(spark: SparkSession, path: str) -> DataFrame:
    """Paths and lengths of the files that ``path`` names, whatever they are called, but for those that
    start with ``_`` or ``.``; none is an error. In a folder with a manifest only the files it names count.
    The content column is pruned from the scan."""
    files = spark.read.format("binaryFile").load(path).select("path", "length")
    listed = f"{path.rstrip('/')}/{MANIFEST}/files.csv"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(listed)
    if "*" not in path and hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        named = spark.read.schema(_MANIFEST_SCHEMA).csv(listed).select(F.col("file").alias("_file"))
        files = files.withColumn("_file", F.element_at(F.split("path", "/"), -1)).join(named, "_file", "left_semi").drop("_file")
    if files.isEmpty():
        raise ValueError(f"no files to read at {path}")
    return files


def _longs_of(data: bytes, at: int, count: int = 1) -> np.ndarray:
    return np.frombuffer(data, ">i8", count, at)


def _by_bytes(table: DataFrame, name: str, order: list[str], size: Column) -> DataFrame:
    """The rows of a short table of files or ranges, dealt in order to tasks of at most about ``RANGE_BYTES`` and one row more.

    There are as many tasks as cores at least, if there are as many rows.
    """
    spark = table.sparkSession
    size = size.cast("long") + 1
    rows, seen = Scratch.of(spark).save(table.withColumn("_size", size), name, n=F.count(F.lit(1)), total=F.sum(size))
    tasks = max(1, min(seen["n"], max(-(-seen["total"] // RANGE_BYTES), spark.sparkContext.defaultParallelism)))
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)  # one row for each file or range
    task = F.floor(F.coalesce(F.sum("_size").over(before), F.lit(0)) / F.lit((seen["total"] + 1) / tasks)).cast("int")
    return rows.withColumn("_task", task).repartitionById(tasks, "_task").drop("_size", "_task")


class _Heads:
    """The heads of a file's records, read with little else of it."""

    def __init__(self, file, size: int):
        self.file, self.size, self.at, self.held = file, size, 0, b""

    def bytes(self, at: int, n: int) -> bytes:
        if at + n > self.size:
            raise ValueError(f"file ends inside a record: {n} bytes wanted at {at} of {self.size}")
        if not self.at <= at <= at + n <= self.at + len(self.held):
            self.file.seek(at)
            self.at, self.held = at, self.file.read(max(n, min(_AHEAD, self.size - at)))
        return self.held[at - self.at:at - self.at + n]

    def number(self, at: int, n: int) -> int:
        return int.from_bytes(self.bytes(at, n), "big", signed=True)


def _adjacency_head(heads: _Heads, at: int) -> tuple[int, int, list[tuple[str, int, int]]]:
    """Part, vertex, and ``(name, first byte, longs)`` of the lists of a record."""
    return 0, heads.number(at + 4, 8), [("near", at + 12, heads.number(at, 4) - 1)]


def _partitioned_head(heads: _Heads, at: int) -> tuple[int, int, list[tuple[str, int, int]]]:
    near = heads.number(at + 9, 4)
    far_at = at + 13 + 8 * near
    return heads.number(at, 1), heads.number(at + 1, 8), [("near", at + 13, near), ("far", far_at + 4, heads.number(far_at, 4))]


_HEADS = {"adjacency": _adjacency_head, "partitioned": _partitioned_head}
_INDEX = "path string, at long, to long, part int, vid long, list string, chunk int"


def _ranges_of(layout: str, piece: int, range_bytes: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranges of whole records ``(path, at, to)`` with the number ``chunk`` of the first row if ``vid`` goes on there; and of lists.

    A row with ``list`` is a stretch of one list of ``vid``, whose rows are numbered from ``chunk``.
    """
    head = _HEADS[layout]
    for batch in batches:
        rows = []
        for path, size in zip(batch["path"].to_pylist(), batch["length"].to_pylist(), strict=True):
            goes_on = _GOES_ON.search(path)
            last, number = None, int(goes_on[1]) * max(1, -(-int(goes_on[2]) // piece)) if goes_on else 0
            if size <= range_bytes:
                rows.append((path, 0, size, None, None, None, number))
                continue
            system, name = _open(path)
            with system.open_input_file(name) as file:
                heads, at, begin, base = _Heads(file, size), 0, 0, (None, number)
                while at < size:
                    part, vid, lists = head(heads, at)
                    end = lists[-1][1] + 8 * lists[-1][2]
                    if end > size:
                        raise ValueError(f"file ends inside a record: {end} bytes wanted, {size} found")
                    if last is not None and vid != last:
                        number = 0
                    large = end - at > range_bytes and any(n for _, _, n in lists)
                    if large or at - begin >= range_bytes:
                        if at > begin:
                            rows.append((path, begin, at, None, base[0], None, base[1]))
                        begin, base = at, (vid, number)
                    if large:
                        step = 8 * piece * max(1, range_bytes // (8 * piece))
                        for kind, first, count in lists:
                            for a in range(first, first + 8 * count, step):
                                b = min(a + step, first + 8 * count)
                                rows.append((path, a, b, part, vid, kind, number))
                                number += -(-(b - a) // (8 * piece))
                        begin, base = end, (vid, number)
                    else:
                        near, far = lists[0][2], lists[-1][2] if len(lists) > 1 else 0
                        number += int(_rows_of(np.array([near]), np.array([far]), piece)[0])
                    at, last = end, vid
                    if begin == at:
                        base = (last, number)
                if begin < size:
                    rows.append((path, begin, size, None, base[0], None, base[1]))
        if rows:
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["path", "at", "to", "part", "vid", "list", "chunk"])


def _rows_of(near: np.ndarray, far: np.ndarray, piece: int) -> np.ndarray:
    """Rows that records with lists of these lengths become; the last row of the first list holds the first of the second."""
    a, b = -(-near // piece), -(-far // piece)
    return np.maximum(a, 1) - 1 + np.maximum(b, 1)


def _records(layout: str, data: bytes) -> tuple[np.ndarray, ...]:
    """Part, vertex, lengths of both lists, and the longs of both, of whole records."""
    raw, at, starts, lengths = np.frombuffer(data, np.uint8), 0, [], []
    heads = _Heads(io.BytesIO(data), len(data))
    heads.held = data
    while at < len(data):
        _, _, lists = _HEADS[layout](heads, at)
        starts.append(at)
        lengths.append([n for _, _, n in lists])
        at = lists[-1][1] + 8 * lists[-1][2]
    if at > len(data):
        raise ValueError(f"file ends inside a record: {at} bytes wanted, {len(data)} found")
    start = np.array(starts, np.int64)
    length = np.array(lengths, np.int64).reshape(len(starts), -1)
    near, far = length[:, 0], length[:, 1] if length.shape[1] > 1 else np.zeros(len(start), np.int64)
    longs = np.ones(len(raw), bool)
    lead = 12 if layout == "adjacency" else 13
    longs[(start[:, None] + np.arange(lead)).ravel()] = False
    if layout == "partitioned":
        longs[((start + lead + 8 * near)[:, None] + np.arange(4)).ravel()] = False
    values = raw[longs].view(">i8").astype(np.int64)
    vid = raw[(start[:, None] + (4 if layout == "adjacency" else 1) + np.arange(8)).ravel()].view(">i8").astype(np.int64)
    part = raw[start].view(np.int8).astype(np.int32) if layout == "partitioned" else np.zeros(len(start), np.int32)
    first = np.repeat(np.tile([True, False], len(near)), np.stack([near, far], 1).ravel())
    return part, vid, near, far, values[first], values[~first]


def _row_batches(layout: str, piece: int, row: dict) -> Iterator[pa.RecordBatch]:
    """The rows of one range of the index."""
    system, name = _open(row["path"])
    with system.open_input_file(name) as file:
        file.seek(row["at"])
        data = file.read(row["to"] - row["at"])
    if row["list"]:
        values = np.frombuffer(data, ">i8").astype(np.int64)
        none = np.empty(0, np.int64)
        near, far = (values, none) if row["list"] == "near" else (none, values)
        part, vid, n, m = np.array([row["part"]], np.int32), np.array([row["vid"]]), np.array([len(near)]), np.array([len(far)])
        begins = row["vid"]
    else:
        part, vid, n, m, near, far = _records(layout, data)
        begins = row["vid"] if row["vid"] is not None else vid[0] if len(vid) else None
    rows = _rows_of(n, m, piece)
    of = np.repeat(np.arange(len(vid)), rows)
    j = np.arange(len(of)) - np.repeat(np.cumsum(rows) - rows, rows)
    size = lambda length, number: np.where(number >= 0, np.clip(length - number * piece, 0, piece), 0)
    near_size = size(n[of], j)
    far_size = size(m[of], j - np.maximum(-(-n[of] // piece) - 1, 0))
    new = np.ones(len(of), bool)  # rows of one vertex in a row are parts of its lists
    new[1:] = vid[of][1:] != vid[of][:-1]
    run = np.cumsum(new) - 1
    chunk = np.arange(len(of)) - np.flatnonzero(new)[run] if len(of) else np.empty(0, np.int64)
    if len(of) and vid[0] == begins:
        chunk = chunk + np.where(run == 0, row["chunk"], 0)
    lists = lambda sizes, flat: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(flat, pa.int64()))
    columns = {"part": pa.array(part[of], pa.int32()), "vid": pa.array(vid[of], pa.int64()), "chunk": pa.array(chunk, pa.int32()),
               "near": lists(near_size, near), "far": lists(far_size, far)}
    if layout == "adjacency":
        yield pa.record_batch([columns[c] for c in ("vid", "chunk", "near")], names=["vid", "chunk", "nbrs"])
    else:
        yield pa.record_batch(list(columns.values()), names=["part", "vid", "chunk", "local", "packed"])


def _read_records(spark: SparkSession, path: str, layout: str, piece: int, schema: str, range_bytes: int) -> DataFrame:
    read = F.when(F.col("length") > range_bytes, F.col("length")).otherwise(0)  # a short file is one range
    files = _by_bytes(_files(spark, path), "files", ["path"], read)
    index = files.mapInArrow(partial(_ranges_of, layout, piece, range_bytes), _INDEX)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield from _row_batches(layout, piece, row)

    return _by_bytes(index, "ranges", ["path", "at"], F.col("to") - F.col("at")).mapInArrow(decode, schema)


def read_adjacency_binary(
    spark: SparkSession, path: str, list_rows: int = GROUP_ROWS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """``adjacency`` from big-endian ``[degree+1 int][vid long][sink long]*``.

    A file of more than ``range_bytes`` is read by several tasks, and so is a record of that size.
    """
    return _read_records(spark, path, "adjacency", list_rows, "vid long, chunk int, nbrs array<long>", range_bytes)


def read_partitioned_binary(
    spark: SparkSession, path: str, grouped: bool = True, list_rows: int = GROUP_ROWS, range_bytes: int = RANGE_BYTES
) -> DataFrame:
    """Partitioned adjacency from ``[part byte][vid long][n int][long]*n[n int][part<<56 | vid]*n``.

    ``grouped`` gives remotes as a map by part, else as a list of structs ``(vid, part)``. A list
    longer than ``list_rows`` goes over several rows.
    """
    rows = _read_records(
        spark, path, "partitioned", list_rows, "part int, vid long, chunk int, local array<long>, packed array<long>", range_bytes)
    remotes = F.transform(
        "packed",
        lambda x: F.struct(
            x.bitwiseAND(F.lit(VERTEX_MASK)).alias("vid"), F.shiftright(x, PART_SHIFT).cast("int").alias("part")
        ),
    )
    listed = rows.select("part", "vid", "chunk", "local", remotes.alias("remote_ids"))
    if not grouped:
        return listed
    return listed.select("part", "vid", "chunk", "local", remote_map(F.col("remote_ids")).alias("remote"))


def _ranges(spark: SparkSession, path: str) -> DataFrame:
    """Byte ranges of files of fixed records, spread over tasks."""
    step = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(RANGE_BYTES).cast("long"))
    ranges = _files(spark, path).select("path", "length", F.explode(step).alias("at"))
    return _by_bytes(ranges, "ranges", ["path", "at"], F.least(F.col("length") - F.col("at"), F.lit(RANGE_BYTES)))


def _longs_at(row: dict, record: int) -> np.ndarray:
    system, name = _open(row["path"])
    size = min(RANGE_BYTES, row["length"] - row["at"])
    if size % record:
        raise ValueError(f"{row['path']} is no whole number of records")
    with system.open_input_file(name) as f:
        f.seek(row["at"])
        return np.frombuffer(f.read(size), ">i8").astype("int64")


def read_vertex_map(spark: SparkSession, path: str) -> DataFrame:
    """``vertex_map(vid, rel_vid)`` from pairs of longs, large files by byte range."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                longs = _longs_at(row, MAP_RECORD).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(longs[:, 0]), pa.array(longs[:, 1])], ["vid", "rel_vid"])

    return _ranges(spark, path).mapInArrow(decode, "vid long, rel_vid long")


def read_tour_binary(spark: SparkSession, path: str) -> DataFrame:
    """``(seq, vid)`` from longs in the order of visits, over all files in name order."""
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                longs = _longs_at(row, 8)
                seq = row["base"] + row["at"] // 8 + np.arange(len(longs))
                yield pa.RecordBatch.from_arrays([pa.array(seq), pa.array(longs)], ["seq", "vid"])

    before = Window.orderBy("path").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    bases = _files(spark, path).select("path", F.coalesce(F.sum("length").over(before) / 8, F.lit(0)).cast("long").alias("base"))
    return _ranges(spark, path).join(bases, "path").mapInArrow(decode, "seq long, vid long")


def _put(buffer: np.ndarray, at: np.ndarray, values: np.ndarray, kind: str) -> None:
    """Scatter big-endian values to byte positions."""
    raw = np.ascontiguousarray(values.astype(kind))
    buffer[at[:, None] + np.arange(raw.itemsize)] = raw.view(np.uint8).reshape(-1, raw.itemsize)


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return np.asarray(column.value_lengths().fill_null(0), "int64"), np.asarray(column.flatten(), "int64")


def _spots(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Byte position of every long of lists that start at ``starts``."""
    inside = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    return np.repeat(starts, counts) + 8 * inside


def _encode_adjacency(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    counts, flat = _lists(batch["nbrs"])
    sizes = 12 + 8 * counts
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    _put(out, starts, counts + 1, ">i4")
    _put(out, starts + 4, np.asarray(batch["vid"]), ">i8")
    _put(out, _spots(starts + 12, counts), flat, ">i8")
    return out, int(counts.sum())


def _encode_partitioned(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    near, local = _lists(batch["local"])
    far, packed = _lists(batch["packed"])
    sizes = 17 + 8 * (near + far)
    starts = np.cumsum(sizes) - sizes
    out = np.empty(int(sizes.sum()), np.uint8)
    _put(out, starts, np.asarray(batch["part"]), ">i1")
    _put(out, starts + 1, np.asarray(batch["vid"]), ">i8")
    _put(out, starts + 9, near, ">i4")
    _put(out, _spots(starts + 13, near), local, ">i8")
    _put(out, starts + 13 + 8 * near, far, ">i4")
    _put(out, _spots(starts + 17 + 8 * near, far), packed, ">i8")
    return out, int(near.sum() + far.sum())


def _encode_map(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    pairs = np.stack([np.asarray(batch["vid"]), np.asarray(batch["rel_vid"])], axis=1).astype(">i8")
    return pairs.reshape(-1).view(np.uint8), 0


def _encode_tour(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    return np.asarray(batch["vid"]).astype(">i8").view(np.uint8), 0


def _encode_text(batch: pa.RecordBatch) -> tuple[np.ndarray, int]:
    return np.frombuffer("".join(batch["text"].to_pylist()).encode(), np.uint8), 0


_ENCODERS = {
    "text": _encode_text,
    "adjacency": _encode_adjacency, "partitioned": _encode_partitioned, "vertex_map": _encode_map, "tour": _encode_tour,
}


@dataclass
class _Written(WriterCommitMessage):
    files: list  # (file, vertices, edges, bytes)


class _Writer(DataSourceArrowWriter):
    """One file per task, or per ``file_key`` of a task, in a folder and under a name of the attempt's own.

    A file counts once the manifest names it: nothing is moved, and files of lost attempts are never read.
    """

    def __init__(self, path: str, layout: str):
        self.path, self.layout = path.rstrip("/"), layout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        system, folder = _open(self.path)
        system.create_dir(folder, recursive=True)
        done, key, sink = [], None, None
        for batch in iterator:
            for name, piece in self._by_key(batch, f"part-{task:05d}"):
                if name != key:
                    if sink:
                        sink.close()
                    key = name
                    file = f"{name}-{attempt}{self._goes_on(piece)}.bin"
                    sink = system.open_output_stream(f"{folder}/{file}")
                    done.append([file, 0, 0, 0])
                data, edges = _ENCODERS[self.layout](piece)
                sink.write(data.tobytes())
                done[-1][1] += piece.num_rows
                done[-1][2] += edges
                done[-1][3] += len(data)
        if sink:
            sink.close()
        return _Written(done)

    @staticmethod
    def _by_key(batch: pa.RecordBatch, default: str) -> Iterator[tuple[str, pa.RecordBatch]]:
        if "file_key" not in batch.schema.names:
            yield default, batch
            return
        keys = np.asarray(batch["file_key"].to_pylist())
        cuts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1), len(keys)]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield str(keys[a]), batch.slice(a, b - a)

    @staticmethod
    def _goes_on(piece: pa.RecordBatch) -> str:
        """Marks a file whose first record goes on with a vertex."""
        before = piece["before"][0].as_py() if "before" in piece.schema.names else 0
        return f"-c{before}x{piece['longest'][0].as_py()}" if before else ""

    def commit(self, messages: list) -> None:
        system, folder = _open(self.path)
        text = io.StringIO()
        csv.writer(text).writerows(row for message in messages if message for row in message.files)
        system.create_dir(f"{folder}/{MANIFEST}", recursive=True)
        with system.open_output_stream(f"{folder}/{MANIFEST}/files.csv") as out:
            out.write(text.getvalue().encode())

    def abort(self, messages: list) -> None:
        system, folder = _open(self.path)
        for message in messages:
            for file, *_ in message.files if message else []:
                system.delete_file(f"{folder}/{file}")


class BinaryGraphSink(DataSource):
    """``df.write.format("graphtrails_binary").option("layout", ...)``."""

    @classmethod
    def name(cls) -> str:
        return "graphtrails_binary"

    def writer(self, schema: StructType, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], self.options["layout"])


def _must_be_new(spark: SparkSession, path: str) -> None:
    """A sink never mixes its files with others: the folder must be missing or empty."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    system = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if system.exists(target) and len(system.listStatus(target)):
        raise ValueError(f"{path} is not empty")


def _write(df: DataFrame, path: str, layout: str) -> DataFrame:
    spark = df.sparkSession
    _must_be_new(spark, path)
    spark.dataSource.register(BinaryGraphSink)
    df.write.format("graphtrails_binary").option("layout", layout).mode("append").save(path)
    return spark.read.schema(_MANIFEST_SCHEMA).csv(f"{path.rstrip('/')}/{MANIFEST}/files.csv")


#: Bytes of records in one file of the sink.
FILE_BYTES = 256 << 20


def _dealt(
    rows: DataFrame, groups: list[str], order: list[str], size: Column, values: list[str], file_bytes: int
) -> tuple[DataFrame, int]:
    """Add ``_file``, the number of a row's file in its group by the running sum of bytes, and what its name needs.

    ``before`` counts the vertex's rows before it, ``longest`` is the length of its longest list. ``_task`` numbers the files of
    all groups, below the second result, so that each can be a task's own.
    """
    scratch = Scratch.of(rows.sparkSession)
    sized = rows.withColumn("_bytes", size.cast("long"))
    longest = F.max(F.greatest(*[F.size(v) for v in values], F.lit(0))).alias("longest")
    keys = sized.groupBy(*groups, *order).agg(F.sum("_bytes").alias("_bytes"), longest)  # once, should a row stand twice
    summed = scratch.save(prefix_sum(keys, [F.col(c) for c in [*groups, *order]], "_bytes", "_sum", scratch), "sums")
    spans = summed.groupBy(*groups).agg(F.min("_sum").alias("_first"), F.max("_sum").alias("_last")).collect()  # a row for each group
    firsts, files = [], 0
    for span in spans:
        if span["_first"] is not None:
            firsts.append((*[span[g] for g in groups], span["_first"], files))
            files += (span["_last"] - span["_first"]) // file_bytes + 1
    schema = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in summed.select(*groups).schema], "_first long", "_base long"])
    starts = rows.sparkSession.createDataFrame(firsts, schema)
    numbered = summed.join(F.broadcast(starts), groups) if groups else summed.crossJoin(F.broadcast(starts))
    file = F.expr(f"(_sum - _first) div {file_bytes}")
    numbered = numbered.select(*groups, *order, file.alias("_file"), (F.col("_base") + file).cast("int").alias("_task"))
    several = summed.filter("chunk > 0").groupBy(*groups, "vid").agg(F.max("longest").alias("longest"))
    dealt = rows.join(numbered, [*groups, *order]).join(several, [*groups, "vid"], "left").withColumn(
        "longest", F.coalesce("longest", F.lit(1))).withColumn("before", F.col("chunk").cast("long"))
    return dealt, max(1, files)


def write_adjacency_binary(adj: DataFrame, path: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write files of about ``file_bytes`` into a new folder; return the manifest ``(file, vertices, edges, bytes)``.

    The format has no chunks: the rows of one vertex are records next to each other, over several files if they fill
    them, which the reader numbers again. File names sort like the vertices.
    """
    adj = Scratch.of(adj.sparkSession).kept(adj, "adjacency")
    dealt, files = _dealt(adj, [], ["vid", "chunk"], 12 + 8 * F.size("nbrs"), ["nbrs"], file_bytes)
    keyed = dealt.withColumn("file_key", F.format_string("part-%08d", "_file"))
    placed = keyed.repartitionById(files, "_task").sortWithinPartitions("_file", "vid", "chunk")
    return _write(placed.select("file_key", "vid", "nbrs", "before", "longest"), path, "adjacency")


def write_partitioned_binary(
    pa_table: DataFrame, path: str, splits: int = 8, file_bytes: int = FILE_BYTES
) -> DataFrame:
    """Write the rows of part ``p`` to files ``split-<p % splits>-<n>-...bin`` of about ``file_bytes``; return the manifest.

    Parts must fit a signed byte in this format.
    """
    packed = F.flatten(
        F.transform(
            F.map_entries("remote"), lambda e: F.transform(e["value"], lambda v: pack_remote(e["key"], v))
        )
    )
    part = F.when(F.col("part").between(0, 127), F.col("part")).otherwise(
        F.raise_error(F.lit("part ids above 127 do not fit this format")).cast("int")
    )
    rows = pa_table.select(
        F.pmod("part", F.lit(splits)).alias("_split"), part.alias("part"), "vid", "chunk", "local", packed.alias("packed")
    )
    rows = Scratch.of(pa_table.sparkSession).save(rows, "packed")
    dealt, files = _dealt(rows, ["_split"], ["vid", "chunk"], 17 + 8 * (F.size("local") + F.size("packed")), ["local", "packed"], file_bytes)
    keyed = dealt.withColumn("file_key", F.format_string("split-%05d-%08d", "_split", "_file"))
    return _write(
        keyed.repartitionById(files, "_task").sortWithinPartitions("file_key", "vid", "chunk")
        .select("file_key", "part", "vid", "local", "packed", "before", "longest"),
        path, "partitioned",
    )


def write_text(rows: DataFrame, path: str) -> DataFrame:
    """Write ``text`` as it stands, row after row; file names sort like the partitions."""
    return _write(rows.select("text"), path, "text")


def write_vertex_map(vm: DataFrame, path: str) -> DataFrame:
    return _write(vm.select("vid", "rel_vid"), path, "vertex_map")


def write_tour_binary(steps: DataFrame, path: str, trail: str = "component") -> DataFrame:
    """Vertices of closed walks in the order of visits, each walk with its last vertex; restarts are not marked.

    File names sort like the walks. Returns the manifest.
    """
    last = steps.groupBy(trail).agg(F.max("seq").alias("seq")).withColumn("_last", F.lit(True))
    visits = steps.join(last, [trail, "seq"], "left").select(
        trail, "seq", F.inline(F.when(F.col("_last"), F.array(
            F.struct(F.lit(0).alias("_i"), F.col("from_vid").alias("vid")), F.struct(F.lit(1).alias("_i"), F.col("to_vid").alias("vid"))
        )).otherwise(F.array(F.struct(F.lit(0).alias("_i"), F.col("from_vid").alias("vid"))))))
    order = [trail, "seq", "_i"]
    return _write(visits.repartitionByRange(*order).sortWithinPartitions(*order).select("vid"), path, "tour")
