"""Shared pieces of the training-data operators: word and line scanning, hashing, shared tables.

A *word* is a maximal run of ``[^\\x20\\x09-\\x0D]`` everywhere. ``bytes.split()`` and ``bytes.strip()``
use exactly that set of white space, and ``bytes.lower()`` maps A-Z only, so scanning UTF-8 bytes
gives the contracts' rules without a regular expression.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WS = b" \t\n\x0b\x0c\r"
#: Limits of one Arrow batch: a batch of very long texts must still fit in a Python worker.
ARROW_ROWS, ARROW_BYTES = 4096, "8m"
#: Rows without a doc_id take this one: below every real id, so that null never wins a "largest id" rule.
NO_ID = -(2**63)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_shipped: set[str] = set()
_made: list[tuple[SparkSession, str]] = []
_registered: list[bool] = []


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: spark.checkpoint.dir. Only one JVM (a local master) may do without it."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = f"file://{tempfile.gettempdir()}/movewise-shared"
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, removed when the driver ends."""
    path = f"{shared_root(spark)}/movewise/{name}-{uuid.uuid4().hex}"
    if not _registered:
        atexit.register(_clean)
        _registered.append(True)
    _made.append((spark, path))
    return path


def staged(df: DataFrame, name: str, rows: int | None = None, per_file: int = 100_000) -> DataFrame:
    """Cuts lineage: writes df as Parquet into the shared folder and reads it back. A lost executor costs nothing that was written.

    rows: how many there are at most, where that is known; a small table is then written as a few files, not one for each partition.
    """
    spark = df.sparkSession
    path = shared_path(spark, name)
    if rows is not None and (files := 1 + rows // per_file) < parts(spark):
        df = df.coalesce(files)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def mark() -> int:
    """Remembers which folders exist by now; see discard."""
    return len(_made)


def discard(since: int, *keep: DataFrame) -> None:
    """Deletes the folders made since a mark, but for those of staged frames to be kept. Nothing else may still read them."""
    stay = {getattr(df, "_written", None) for df in keep}
    gone = [x for x in _made[since:] if x[1] not in stay]
    _made[since:] = [x for x in _made[since:] if x[1] in stay]
    for spark, path in gone:
        _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone already
            return


def arrow_rows(spark: SparkSession) -> None:
    """Keeps Arrow batches small in bytes even where texts are long, and lets executors import this package."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)
    if spark.sparkContext.applicationId not in _shipped:
        here = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        to = os.path.join(tempfile.mkdtemp(), "movewise.zip")
        with zipfile.ZipFile(to, "w") as z:
            for folder, _, names in os.walk(here):
                for name in names:
                    if name.endswith((".py", ".sql")):
                        full = os.path.join(folder, name)
                        z.write(full, os.path.relpath(full, os.path.dirname(here)))
        spark.sparkContext.addPyFile(to)
        _shipped.add(spark.sparkContext.applicationId)


#: State that a Python worker keeps from task to task (memos, tables of powers), by the operator that made it.
_kept: dict[str, object] = {}


def kept(owner: str, make: Callable[[], object]) -> object:
    """A worker's state of an operator, made once; state of other operators goes."""
    if owner not in _kept:
        _begin(owner)
        _kept[owner] = make()
    return _kept[owner]


def _begin(owner: str) -> None:
    for name in [x for x in _kept if x != owner]:
        del _kept[name]


def _give_back() -> None:
    """Freed memory goes back to the system, where the C library can do that."""
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):
        return


def map_arrow(df: DataFrame, owner: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """df.mapInArrow(run, schema), in a worker that holds nothing of other operators and gives memory back after each task.

    Python workers are used again and again: without this, every stage would add to what the stages before it left.
    """

    def started(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _begin(owner)
        try:
            yield from run(batches)
        finally:
            _give_back()

    return df.mapInArrow(started, schema)


def identified(docs: DataFrame, *keep: str) -> DataFrame:
    """(_id, _tk, text, keep...): doc_id with null as NO_ID, and a key of the text.

    Rows that repeat a doc_id with another text are kept apart by _tk; rows that repeat both are
    alike in every respect and get the same answers.
    """
    arrow_rows(docs.sparkSession)
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_tk"), text.alias("text"), *[F.col(c) for c in keep])


def real_id(column: str = "_id"):
    """doc_id again from _id."""
    return F.when(F.col(column) != F.lit(NO_ID), F.col(column)).alias("doc_id")


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string or binary array, without a copy where Arrow permits."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    _, offs, data = column.buffers()
    n = len(column)
    off = np.frombuffer(offs, np.int64 if wide else np.int32, count=n + 1, offset=column.offset * (8 if wide else 4)).astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return off - off[0], raw[off[0] : off[-1]]


def slices(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Runs of rows of about `most` bytes; one very long text is a run of its own."""
    i, n = 0, len(off) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + most, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


_WS_TABLE = np.zeros(256, bool)
_WS_TABLE[np.frombuffer(WS, np.uint8)] = True
#: Bytes that are hashed at once, and the powers that a worker keeps for that (16 bytes each).
PIECE = 1 << 19
_pow: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """_BASE**i and its inverse modulo 2**64, i < n. Those below 2 * PIECE are kept."""
    have = _pow.get("up")
    if have is not None and len(have) >= n:
        return have[:n], _pow["down"][:n]
    size = -(-n // (1 << 16)) << 16
    out = []
    with np.errstate(over="ignore"):
        for base in (int(_BASE), pow(int(_BASE), -1, 1 << 64)):
            x = np.ones(size, np.uint64)
            done = 1
            while done < size:
                x[done : 2 * done] = x[: min(done, size - done)] * np.uint64(pow(base, done, 1 << 64))
                done *= 2
            out.append(x)
    if size <= 2 * PIECE:
        _pow["up"], _pow["down"] = out
    return out[0][:n], out[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xFF51AFD7ED558CCD)
        x = x ^ (x >> np.uint64(33))
        x = x * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def span_hash(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit polynomial hash of values[start:end] for many spans at once, by one prefix sum."""
    up, down = powers(len(values) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(values) + 1, np.uint64)
        np.cumsum((values.astype(np.uint64) + np.uint64(1)) * up[: len(values)], out=total[1:])
        return mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64))


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """span_hash of words (in order), over about PIECE bytes at a time: a very long text needs no more memory than others."""
    out = np.zeros(len(start), np.uint64)
    at = 0
    while at < len(start):
        stop = max(at + 1, int(np.searchsorted(end, start[at] + PIECE, "right")))
        low, high = start[at], end[stop - 1]
        out[at:stop] = span_hash(data[low:high], start[at:stop] - low, end[at:stop] - low)
        at = stop
    return out


def lower_ascii(data: np.ndarray) -> np.ndarray:
    out = data.copy()
    out[(data >= 65) & (data <= 90)] += 32
    return out


def words(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word of a run of texts, and the first word of each text (n + 1 entries)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    solid = ~_WS_TABLE[data]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = off[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, np.searchsorted(start, off)


#: Bits of a fixed filter, a power of two: 2 MB, or 16 MB for keys that set more than MANY bits, however many there are.
FEW_BITS, FILTER_BITS = 24, 27
MANY = 1 << 20


def filter_bit(key: np.ndarray, bits: int = FEW_BITS) -> np.ndarray:
    """Where a 64-bit key sets its bit."""
    return (mix(key.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def bitmap_of(cell: np.ndarray, bit: np.ndarray) -> np.ndarray:
    """A bitmap from its words of 64 bits that are not 0; up to MANY set bits are folded eight to one, as the leading bits of a key say."""
    if int(np.bitwise_count(bit.view(np.uint64)).sum()) > MANY:
        out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
        out[cell] = bit
        return out
    folded = np.zeros(1 << (FEW_BITS - 3), np.uint8)
    folded[cell] = np.packbits(bit.view(np.uint8).reshape(-1, 8) != 0, axis=1, bitorder="little")[:, 0]
    return folded.view(np.int64)


def fixed_filter(keys: DataFrame, column: str) -> np.ndarray:
    """A bitmap of the keys (long) in a column, merged on the executors.

    It only says which rows certainly have no partner, so that they need not be shuffled; a join must
    follow. Its size is bounded: with too many keys it lets more rows pass, up to all, and nothing is lost.
    """

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = filter_bit(batch.column(0).to_numpy(zero_copy_only=False), FILTER_BITS)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 6), pa.array(np.int64(1) << (at & 63))], ["cell", "bit"])

    arrow_rows(keys.sparkSession)
    rows = keys.select(F.col(column).cast("long")).where(F.col(column).isNotNull())
    cells = map_arrow(rows, "filter", bits, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    return bitmap_of(cells["cell"].to_numpy(), cells["bit"].to_numpy())


def may_hold(bitmap: np.ndarray, key: np.ndarray) -> np.ndarray:
    at = filter_bit(key, (len(bitmap) * 64).bit_length() - 1)
    return (bitmap[at >> 6] >> (at & 63)) & 1 == 1


def let_through(shared, column: str, here: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The rows whose key a broadcast bitmap may hold, or certainly does not hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(may_hold(shared.value, batch[column].to_numpy(zero_copy_only=False)) == here))

    return run


def that_may_meet(rows: DataFrame, keys: DataFrame, column: str, most: int = 1 << (FILTER_BITS - 3)) -> DataFrame:
    """rows whose key (long) is among keys (a staged table of distinct ones), and perhaps some more.

    Up to `most` keys a bitmap decides where rows are read; with more, which would fill the bitmap, a join does.
    """
    if keys.count() > most:
        return rows.join(keys.select(column), column, "left_semi").select(*rows.columns)
    shared = rows.sparkSession.sparkContext.broadcast(fixed_filter(keys, column))
    return map_arrow(rows, "filter", let_through(shared, column), rows.schema)


#: Cells of a frequency sketch: a fixed size however many hashes it counts.
SKETCH_BITS, SKETCH_BLOCK = 22, 16


def sketch_cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)


def _counts(rows: DataFrame, hashes) -> np.ndarray:
    """How often each sketch cell is hit by the hashes of all rows; tasks count into an array of fixed size, and arrays add up on the executors."""
    side = 1 << SKETCH_BLOCK

    def packed(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        return pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([pack(x.astype(np.int64).tobytes()) for x in blocks.values()], pa.binary())], ["block", "counts"])

    def unpacked(blob: bytes) -> np.ndarray:
        import zstandard

        return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << SKETCH_BITS, np.uint32)  # a task reads far fewer hashes than 2**32
        one = np.uint32(1)
        for batch in batches:
            for h in hashes(batch):
                np.add.at(total, sketch_cell(h), one)
        yield packed({i: x for i, x in enumerate(total.reshape(-1, side)) if x.any()})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["counts"].to_pylist(), strict=True):
                counts = unpacked(blob)
                total[block] = total[block] + counts if block in total else counts
        yield packed(total)

    arrow_rows(rows.sparkSession)
    schema = "block long, counts binary"
    out = np.zeros(1 << SKETCH_BITS, np.int64).reshape(-1, side)
    partial = map_arrow(rows, "sketch", count, schema).repartition(min(len(out), parts(rows.sparkSession)), "block")
    for r in map_arrow(partial, "sketch", add, schema).collect():
        out[r["block"]] += unpacked(r["counts"])
    return out.ravel()


def frequency_levels(rows: DataFrame, hashes, least: int = 32) -> tuple[np.ndarray, float, int]:
    """How common the hashes of all rows are: a level from 0 to 15 for each sketch cell; the hits where level 1 begins; the number of hashes.

    hashes(batch) yields uint64 arrays, best a few large ones. Level 0 is a cell within ten standard
    deviations of the mean, or that plus `least` hits; each level above doubles. The driver gets one
    count per cell whatever the input. Orders of hashes that put common ones last use it; any levels
    give right results.
    """
    flat = _counts(rows, hashes)
    mean = float(flat.mean())
    limit = mean + 10 * mean**0.5 + least
    return np.where(flat < limit, 0, np.minimum(15, 1 + np.log2(np.maximum(flat, 1) / limit).clip(0).astype(np.int64))).astype(np.uint8), limit, int(flat.sum())


def ranked(h: np.ndarray, levels: np.ndarray) -> np.ndarray:
    """h in an order that puts common hashes last: the level in the top 4 bits, then the hash."""
    return (levels[sketch_cell(h)].astype(np.uint64) << np.uint64(60)) | (h >> np.uint64(4))


def rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of the n-grams of a hash sequence (len(h) - n + 1 of them)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    out = h[: len(h) - n + 1].copy()
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = out * _BASE + h[j : len(h) - n + 1 + j]
    return mix(out)
