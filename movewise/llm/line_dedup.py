"""Line dedup (operator 10): drop lines that many documents hold.

Explode the normalised lines, hash them (128 bits), count distinct documents per hash, drop the
lines of every hash over the threshold except in its largest document, reassemble by position.

Scale: only (id, position, hash) rows are shuffled for counting, with Spark's partial aggregates on
the map side, first by (hash, document) and then by hash, so a line in a third of all documents
costs one row per task. The lines over the threshold are a written table; lines that a fixed-size
bitmap of it lets through meet it in a join that Spark broadcasts where the table is small by its
size, and that AQE may split where a hash is hot. Only texts whose key a bitmap has seen are shuffled,
to meet their dropped positions; the others are passed on where they are read.

Cases: null or empty text is one empty line (``line_dedup`` leaves null null). A null doc_id is a
document of its own below all others. Rows that repeat doc_id and text get the same answers, and a
line that one document holds often counts once. There are no ties: the largest doc_id is one document.
Very long texts and lines are handled whole. An empty table gives an empty one. Extra columns are
carried along by ``line_dedup``, whatever their names, and ignored by ``line_report``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, WS, arrow_rows, fixed_filter, identified, let_through, map_arrow, may_hold, real_id, staged


def line_key(line: bytes) -> bytes:
    return line.strip(WS).lower()


def _hashed(min_chars: int, shared=None):
    """shared: a bitmap of h1; only lines that it may hold are given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys, pos, high, low = [], [], [], [], []
            for i, k, text in zip(batch["_id"].to_pylist(), batch["_tk"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                for p, line in enumerate(text.split(b"\n")):
                    if len(line) < min_chars:
                        continue
                    key = line_key(line)
                    if len(key) < min_chars or not key.isascii() and len(key.decode()) < min_chars:
                        continue
                    digest = hashlib.blake2b(key, digest_size=16).digest()
                    ids.append(i)
                    keys.append(k)
                    pos.append(p)
                    high.append(int.from_bytes(digest[:8], "little", signed=True))
                    low.append(int.from_bytes(digest[8:], "little", signed=True))
            out = pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(keys, pa.int64()), pa.array(pos, pa.int32()), pa.array(high, pa.int64()), pa.array(low, pa.int64())], ["_id", "_tk", "pos", "h1", "h2"])
            yield out if shared is None else out.filter(pa.array(may_hold(shared.value, np.array(high, np.int64))))

    return run


def hashed_lines(docs: DataFrame, min_chars: int = 40, shared=None) -> DataFrame:
    """(_id, _tk, pos, h1, h2) of every line whose key has min_chars code points or more."""
    return map_arrow(identified(docs), "lines", _hashed(min_chars, shared), "_id long, _tk long, pos int, h1 long, h2 long")


def dropped_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(_id, _tk, gone): the positions that each document loses."""
    counted = hashed_lines(docs, min_chars).groupBy("h1", "h2").agg(F.count_distinct("_id").alias("n"), F.max("_id").alias("keeper"))
    common = staged(counted.where(F.col("n") >= min_docs).select("h1", "h2", "keeper"), "common")
    shared = docs.sparkSession.sparkContext.broadcast(fixed_filter(common, "h1"))
    hit = hashed_lines(docs, min_chars, shared).join(common, ["h1", "h2"]).where(F.col("_id") < F.col("keeper"))
    return hit.groupBy("_id", "_tk").agg(F.collect_set("pos").alias("gone"))


def reassemble(text: bytes, gone: list[int] | None) -> tuple[bytes, int]:
    """The text without the lines at the given positions, and the number of its lines."""
    lines = text.split(b"\n")
    if not gone:
        return text, len(lines)
    out = set(gone)
    return b"\n".join(x for p, x in enumerate(lines) if p not in out), len(lines)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, dropped, sha = [], [], []
        lost = batch["gone"].to_pylist() if "gone" in batch.schema.names else [None] * len(batch)
        for text, gone in zip(batch["text"].cast(pa.binary()).to_pylist(), lost, strict=True):
            kept, n = reassemble(text, gone)
            total.append(n)
            dropped.append(len(gone or ()))
            sha.append(hashlib.sha256(kept).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(total, pa.int64()), pa.array(dropped, pa.int64()), pa.array(sha, pa.string())], ["_id", "n_lines", "n_dropped", "kept_sha256"])


def line_report(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    gone = staged(dropped_positions(docs, min_chars, min_docs), "gone")
    shared = docs.sparkSession.sparkContext.broadcast(fixed_filter(gone, "_tk"))
    rows, out = identified(docs), "_id long, n_lines long, n_dropped long, kept_sha256 string"
    whole = map_arrow(rows, "lines", lambda batches: _reported(let_through(shared, "_tk", False)(batches)), out)
    some = map_arrow(rows, "lines", let_through(shared, "_tk"), rows.schema)
    cut = map_arrow(some.join(gone, ["_id", "_tk"], "left").select("_id", "text", "gone"), "lines", _reported, out)
    return whole.unionByName(cut).select(real_id(), "n_lines", "n_dropped", "kept_sha256")


def line_dedup(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """docs with the common lines gone from text; null texts stay null. Other columns are unchanged."""
    arrow_rows(docs.sparkSession)
    key = (F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("k_id"), F.xxhash64(F.coalesce(F.col("text"), F.lit(""))).alias("k_tk"))
    keyed = docs.select(*[F.col(c).alias(f"c_{i}") for i, c in enumerate(docs.columns)], *key)
    gone = staged(dropped_positions(docs, min_chars, min_docs), "gone").withColumnsRenamed({"_id": "k_id", "_tk": "k_tk", "gone": "k_gone"})
    shared = docs.sparkSession.sparkContext.broadcast(fixed_filter(gone, "k_tk"))
    at = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t if gone is None else reassemble(t.encode(), gone)[0].decode() for t, gone in zip(batch.column(at).to_pylist(), batch["k_gone"].to_pylist(), strict=True)]
            columns = [*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names).drop_columns(["k_id", "k_tk", "k_gone"])

    kept = keyed.drop("k_id", "k_tk")
    whole = map_arrow(keyed, "lines", let_through(shared, "k_tk", False), keyed.schema).drop("k_id", "k_tk")
    joined = map_arrow(keyed, "lines", let_through(shared, "k_tk"), keyed.schema).join(gone, ["k_id", "k_tk"], "left")
    out = whole.unionByName(map_arrow(joined.select(*keyed.columns, "k_gone"), "lines", cut, kept.schema))
    return out.select(*[F.col(f"c_{i}").alias(c) for i, c in enumerate(docs.columns)])
