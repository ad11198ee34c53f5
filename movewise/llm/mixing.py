"""Mixing sources to target weights (operator 1): Sainte-Lague apportionment of equal-token blocks.

Targets are filled like water: every source gets its weight's share of all words, and what would
exceed `most` times a source's size is shared again by weight. The mix then consists of blocks of
about `block` words. Blocks are seats: sources get them by the highest quotients target / (2k + 1), the
shards of a source by the highest quotients size / (2k + 1), both capped at `most` seats for each
block that exists. A shard is cut into blocks that are equal to a word, and a source's seats are
counted in blocks of its own mean size, so that nothing is lost on short last blocks. A shard with q
seats over b blocks takes every block q // b times and the first q % b of a seeded permutation of its
blocks once more.

A shard is a seeded hash of the document within its source, and a source has as many shards as its
size asks for, so a source with a third of all words is spread like the others. The words of a shard
form one stream in seeded order; a document takes what the picked blocks cut from its part of it.

Scale: texts are read once to be counted; everything after that works on (doc_id, source, size).
The only window is within a shard. One row per source and per shard goes through pandas: all sources
in one call (some 100 bytes each, so sources should be names of collections, not URLs by the hundred
million), the shards of a source in one call, a few numbers each (100,000 for 1.6 billion words).

Cases: null source is a source of its own, ordered last. Null text has size 0 and takes nothing. A
null doc_id is hashed like a number. Empty tables give empty results. Rows that repeat are separate
documents; equal ones are interchangeable, so reruns agree as multisets. Ties of quotients go to the
first source by code point, and the first shard. A very long text is a long stretch of its shard's
stream. Other columns are carried along by ``mix``, whatever their names, and ignored by ``mix_report``.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, map_arrow, staged, utf8, words

WORD = r"[^\x20\x09-\x0D]+"
#: Sources whose table may be broadcast (under 100 bytes each).
BROADCAST_SOURCES = 2_000


def sainte_lague(weights: np.ndarray, seats: int, caps: np.ndarray | None = None) -> np.ndarray:
    """Integer seats by the highest quotients weight / (2k + 1), none above its cap; ties go to the first.

    A divisor below which a few seats are still to give is found by halving; those go out one by one.
    """
    w = np.asarray(weights, float)
    cap = np.full(len(w), seats, np.int64) if caps is None else np.minimum(np.asarray(caps, np.int64), seats)
    cap = np.where(w > 0, cap, 0)
    seats = int(min(seats, cap.sum()))
    out = np.zeros(len(w), np.int64)
    if not seats:
        return out
    given = lambda d: np.minimum(cap, np.floor(w / d + 0.5).astype(np.int64))
    low, high = w[w > 0].min() / (2.0 * seats + 2), 2 * w.max() + 1
    while given(low).sum() < seats:
        low /= 2
    for _ in range(200):
        mid = (low + high) / 2
        if given(mid).sum() > seats:
            low = mid
        else:
            high = mid
        if given(high).sum() == seats:
            return given(high)
    out = given(high)
    while (left := seats - int(out.sum())) > 0:  # equal quotients at the divisor
        quotient = np.where(out < cap, w / (2 * out + 1), -1.0)
        out[np.argsort(-quotient, kind="stable")[: min(left, int((quotient == quotient.max()).sum()))]] += 1
    return out


def water_fill(sizes: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Shares of the sum of sizes by weight, none above most * size; the excess is shared again by weight."""
    sizes, weights = np.asarray(sizes, float), np.asarray(weights, float)
    target, free, left = np.zeros(len(sizes)), np.ones(len(sizes), bool), float(sizes.sum())
    while free.any():
        share = left * weights / weights[free].sum()
        over = free & (share > most * sizes)
        if not over.any():
            target[free] = share[free]
            break
        target[over] = most * sizes[over]
        left -= float(target[over].sum())
        free &= ~over
    return target


def _source_plan(weights: tuple[float, ...], most: int, block: int, stream: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["is_null", "name"], key=lambda c: c.map(lambda x: x.encode()) if c.name == "name" else c, kind="stable").reset_index(drop=True)
        size = frame["size"].to_numpy(float)
        w = np.array([weights[i % len(weights)] for i in range(len(frame))])
        target = water_fill(size, w, most)
        shards = np.maximum(np.ceil(size / stream), 1).astype(np.int64)
        seats = sainte_lague(target, math.ceil(size.sum() / block), np.ceil(size * most / block).astype(np.int64) + most * shards)
        return frame[["src"]].assign(source_size=frame["size"].astype("int64"), target=target, seats=seats, shards=shards)

    return run


def _shard_plan(most: int, block: int, seed: int):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("shard").reset_index(drop=True)
        size = frame["size"].to_numpy(np.int64)
        blocks = np.where(size > 0, np.maximum(1, np.round(size / block)), 0).astype(np.int64)
        name = zlib.crc32(frame["src"].iloc[0].encode())
        if frame["target"].iloc[0] >= most * size.sum():
            quota = most * blocks  # the cap holds: everything, as often as it may be taken
        else:
            quota = sainte_lague(size, round(int(frame["seats"].iloc[0]) * block * blocks.sum() / size.sum()), most * blocks)
        some = np.maximum(blocks, 1)
        picked = [_picked(np.random.default_rng([seed, name, s]), b, e) for s, b, e in zip(frame["shard"].tolist(), blocks.tolist(), (quota % some).tolist(), strict=True)]
        return frame[["src", "shard"]].assign(length=size, blocks=blocks, every=quota // some, picked=picked)

    return run


def _picked(rng: np.random.Generator, blocks: int, extra: int) -> list[int]:
    """A bit for each block, 64 to a number: the first `extra` of a permutation."""
    if not extra:
        return []
    bits = np.zeros(-(-blocks // 64) * 64, np.uint8)
    bits[rng.permutation(blocks)[:extra]] = 1
    return np.packbits(bits, bitorder="little").view(np.int64).tolist()


def _source_key(column: str = "source") -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(column).cast("string")), F.lit("n")).alias("src")


def _planned(sized: DataFrame, weights, most: int, block: int, stream: int, seed: int) -> DataFrame:
    """sized (src, h, size and more) with the plan of its shard, its start in the shard's stream, and its pieces.

    pieces: (block, first word, end word, times) of the document, for each block that it meets.
    """
    totals = sized.groupBy("src").agg(F.sum("size").alias("size"))
    named = totals.select("src", "size", (F.col("src") == "n").alias("is_null"), F.substring("src", 2, 1 << 30).alias("name"), F.lit(0).alias("one"))
    plan = staged(named.groupBy("one").applyInPandas(_source_plan(tuple(weights), most, block, stream), "src string, source_size long, target double, seats long, shards long"), "mix-sources")
    small = plan.count() <= BROADCAST_SOURCES
    at = (lambda x: F.broadcast(x)) if small else (lambda x: x)
    dealt = sized.join(at(plan), "src").withColumn("shard", F.pmod("h", "shards"))
    streams = dealt.groupBy("src", "shard").agg(F.sum("size").alias("size"), F.first("seats").alias("seats"), F.first("target").alias("target"))
    quota = streams.groupBy("src").applyInPandas(_shard_plan(most, block, seed), "src string, shard long, length long, blocks long, every long, picked array<bigint>")
    order = Window.partitionBy("src", "shard").orderBy("h", "doc_id", "size")
    begun = dealt.withColumn("start", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
    c = F.col
    edge = lambda k: F.floor(k * c("length") / c("blocks")) - c("start")  # noqa: E731  where block k begins, counted from the document's first word
    holder = lambda w: F.floor(((w + 1) * c("blocks") - 1) / c("length"))  # noqa: E731  the block of a word of the stream
    met = F.when(c("size") > 0, F.sequence(holder(c("start")), holder(c("start") + c("size") - 1)))
    more = lambda k: F.coalesce(F.getbit(F.get("picked", F.floor(k / 64).cast("int")), (k % 64).cast("int")), F.lit(0))
    piece = lambda k: F.struct(F.greatest(edge(k), F.lit(0)).alias("first"), F.least(edge(k + 1), c("size")).alias("end"), (c("every") + more(k)).cast("long").alias("times"))
    return begun.join(quota, ["src", "shard"]).withColumn("pieces", F.coalesce(F.transform(met, piece), F.array().cast("array<struct<first:bigint,end:bigint,times:bigint>>")))


def _sized(docs: DataFrame, seed: int, *more: Column) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), _source_key(), size.alias("size"), *more).withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "size"))


def mix_report(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: int = 3, block: int = 64, stream: int = 16_384, seed: int = 17) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    arrow_rows(docs.sparkSession)
    taken = F.aggregate("pieces", F.lit(0).cast("long"), lambda a, p: a + (p["end"] - p["first"]) * p["times"])
    return _planned(staged(_sized(docs, seed), "mix-sizes"), weights, most, block, stream, seed).select("doc_id", "size", "source_size", "target", taken.alias("taken"))


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each text once per round that takes from it: the words of the blocks taken in that round, white space between them kept."""
    for batch in batches:
        rows, texts = [], []
        for i, (text, pieces) in enumerate(zip(batch["text"].to_pylist(), batch["pieces"].to_pylist(), strict=True)):
            most = max((p["times"] for p in pieces), default=0)
            off, data = utf8(pa.array([text]))
            raw, bounds = data.tobytes(), None
            for turn in range(1, most + 1):
                rows.append(i)
                if all(p["times"] >= turn for p in pieces):
                    texts.append(text)
                    continue
                if bounds is None:
                    bounds = words(off, data)
                spans: list[list[int]] = []
                for p in pieces:
                    if p["times"] >= turn:
                        if spans and spans[-1][1] == p["first"]:
                            spans[-1][1] = p["end"]
                        else:
                            spans.append([p["first"], p["end"]])
                texts.append(b"\n".join(raw[bounds[0][a] : bounds[1][b - 1]] for a, b in spans).decode())
        picked = batch.take(pa.array(rows, pa.int64()))
        cols = [pa.array(texts, pa.string()) if name == "text" else picked[name] for name in picked.schema.names if name != "pieces"]
        yield pa.RecordBatch.from_arrays(cols, [x for x in picked.schema.names if x != "pieces"])


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), most: int = 3, block: int = 64, stream: int = 16_384, seed: int = 17) -> DataFrame:
    """The mixed corpus itself: a row for each round (of up to `most`) in which a document gives words.

    Columns and their order are those of docs. text holds the words taken in that round; a document
    taken whole keeps its text as it is. Documents of which nothing is taken are absent.
    """
    arrow_rows(docs.sparkSession)
    columns = {c: f"c_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    kept = [F.col(c).alias(a) for c, a in columns.items()]
    sized = _sized(docs, seed)
    plan = staged(_planned(staged(sized, "mix-sizes"), weights, most, block, stream, seed).select("src", "h", "doc_id", "size", "pieces", F.row_number().over(Window.partitionBy("src", "h", "doc_id", "size").orderBy("start")).alias("copy")), "mix-plan")
    rows = _sized(docs, seed, F.coalesce(F.col("text"), F.lit("")).alias("text"), *kept).withColumn("copy", F.row_number().over(Window.partitionBy("src", "h", "doc_id", "size").orderBy(F.xxhash64("text"))))
    on = (rows["src"] == plan["src"]) & (rows["h"] == plan["h"]) & rows["doc_id"].eqNullSafe(plan["doc_id"]) & (rows["size"] == plan["size"]) & (rows["copy"] == plan["copy"])
    joined = rows.join(plan, on).select(rows["doc_id"], "text", *columns.values(), "pieces")
    flat = [f for f in joined.schema.fields if f.name != "pieces"]
    cut = map_arrow(joined, "mixing", _cut, type(joined.schema)(flat))
    return cut.select(*[(F.col("doc_id").cast(docs.schema["doc_id"].dataType) if c == "doc_id" else F.col(columns.get(c, c))).alias(c) for c in docs.columns])
