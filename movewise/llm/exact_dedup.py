"""Exact dedup (operator 9): counting quotient filters, merged without loss, then byte verification.

Every text gets a 64-bit fingerprint of its bytes without white space. Each partition builds a
counting quotient filter per block of the fingerprint space; the filters of a block merge by their
sorted remainders, adding counts, and lose nothing. A fingerprint counted once needs no more work.
One counted more often is routed to byte verification: its texts are grouped by their bytes.

Scale: a filter holds a fingerprint and a count however often a text repeats. A bitmap of fixed size
keeps most texts that certainly do not repeat out of the shuffle, and the rest is collapsed in each
map task, so a text that makes up a third of all rows travels as one row per task. The class is joined back to digests only (no texts), as a sort-merge join that
AQE may split.

Cases: null counts as empty text. A null doc_id ranks after all others as a keeper. Ties of length
go to the smallest doc_id. Of rows that repeat the keeper's doc_id, length and normalised text, kept is
true for one: a tag that each row gets when it is read decides. Empty tables give empty results; other
columns are ignored, whatever their names. Very long texts are held once per task, normalised.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WS, arrow_rows, fixed_filter, map_arrow, may_hold, parts, staged

#: Stands for a null doc_id here: it must lose every "smallest doc_id" tie.
LAST_ID = 2**63 - 1
#: A map task emits its collapsed texts whenever it holds this many bytes.
FLUSH_BYTES = 16 << 20


class CountingQuotientFilter:
    """The fingerprints of one block as quotient runs of sorted remainders, with counts.

    Slots hold remainders in order. `occupied` has a bit for each quotient with a run, `runend` a
    bit for each slot that ends one; from these the fingerprints come back exactly. Counters are
    kept for slots above one.
    """

    def __init__(self, qbits: int, rbits: int) -> None:
        self.qbits, self.rbits = qbits, rbits
        self.fingerprints, self.counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    @classmethod
    def build(cls, fingerprints: np.ndarray, qbits: int, rbits: int, counts: np.ndarray | None = None) -> CountingQuotientFilter:
        out = cls(qbits, rbits)
        order = np.argsort(fingerprints, kind="stable")
        f = fingerprints[order]
        c = np.ones(len(f), np.int64) if counts is None else counts[order]
        if len(f):
            head = np.flatnonzero(np.r_[True, f[1:] != f[:-1]])
            out.fingerprints, out.counts = f[head], np.add.reduceat(c, head)
        return out

    def merge(self, *others: CountingQuotientFilter) -> CountingQuotientFilter:
        """Sorted remainders meet in order and equal ones add their counts: nothing is lost or rounded."""
        every = [self, *others]
        return self.build(np.concatenate([x.fingerprints for x in every]), self.qbits, self.rbits, np.concatenate([x.counts for x in every]))

    def dump(self) -> bytes:
        quotient = (self.fingerprints >> np.uint64(self.rbits)).astype(np.int64)
        remainder = self.fingerprints & np.uint64((1 << self.rbits) - 1)
        occupied = np.zeros(1 << self.qbits, bool)
        occupied[quotient] = True
        runend = np.ones(len(quotient), bool)
        runend[:-1] = quotient[1:] != quotient[:-1]
        many = np.flatnonzero(self.counts > 1)
        head = np.array([self.qbits, self.rbits, len(quotient), len(many)], np.int64)
        return b"".join(x.tobytes() for x in (head, np.packbits(occupied), np.packbits(runend), remainder, many.astype(np.int64), self.counts[many]))

    @classmethod
    def load(cls, blob: bytes) -> CountingQuotientFilter:
        qbits, rbits, n, m = (int(x) for x in np.frombuffer(blob, np.int64, 4))
        at = 32
        size = (1 << qbits) + 7 >> 3
        occupied = np.unpackbits(np.frombuffer(blob, np.uint8, size, at), count=1 << qbits).astype(bool)
        at += size
        runend = np.unpackbits(np.frombuffer(blob, np.uint8, n + 7 >> 3, at), count=n)
        at += n + 7 >> 3
        remainder = np.frombuffer(blob, np.uint64, n, at)
        at += 8 * n
        many = np.frombuffer(blob, np.int64, m, at)
        at += 8 * m
        out = cls(qbits, rbits)
        run = np.cumsum(runend) - runend
        out.fingerprints = (np.flatnonzero(occupied)[run].astype(np.uint64) << np.uint64(rbits)) | remainder if n else np.zeros(0, np.uint64)
        out.counts = np.ones(n, np.int64)
        out.counts[many] = np.frombuffer(blob, np.int64, m, at)
        return out


def normal(text: bytes) -> bytes:
    return text.translate(None, WS)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [normal(x) for x in batch["text"].cast(pa.binary()).to_pylist()]
        fp = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
        sha = [hashlib.sha256(x).digest() for x in texts]
        yield pa.RecordBatch.from_arrays([batch["_id"], batch["n"], batch["tag"], pa.array(fp), pa.array(sha, pa.binary())], ["_id", "n", "tag", "fp", "sha"])


def _filters(bits: int, qbits: int):
    """A filter per block of 2**(64 - bits) fingerprints, from everything that the task has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held = [], 0

        def out() -> pa.RecordBatch:
            f = np.sort(np.concatenate(seen).view(np.uint64)) if seen else np.zeros(0, np.uint64)
            block = (f >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(f), np.int64)
            cut = np.flatnonzero(np.r_[True, block[1:] != block[:-1]]) if len(f) else np.zeros(0, np.int64)
            mask = np.uint64((1 << (64 - bits)) - 1)
            blobs = [CountingQuotientFilter.build(x & mask, qbits, 64 - bits - qbits).dump() for x in np.split(f, cut[1:])] if len(f) else []
            return pa.RecordBatch.from_arrays([pa.array(block[cut]), pa.array(blobs, pa.binary())], ["block", "filter"])

        for batch in batches:
            seen.append(batch["fp"].to_numpy(zero_copy_only=False))
            held += len(seen[-1])
            if held > 1 << 20:
                yield out()
                seen, held = [], 0
        yield out()

    return run


def _repeated(bits: int):
    """Merges the filters of each block, which arrive together, and yields what is counted more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pile = None, []

        def out() -> pa.RecordBatch:
            whole = pile[0].merge(*pile[1:])
            many = whole.counts > 1
            block = np.uint64(now << (64 - bits) if bits else 0)
            return pa.RecordBatch.from_arrays([pa.array((whole.fingerprints[many] | block).view(np.int64)), pa.array(whole.counts[many])], ["fp", "seen"])

        for batch in batches:
            for block, blob in zip(batch["block"].to_pylist(), batch["filter"].to_pylist(), strict=True):
                if now is not None and block != now:
                    yield out()
                    pile = []
                now = block
                pile.append(CountingQuotientFilter.load(blob))
                if len(pile) >= 64:
                    pile = [pile[0].merge(*pile[1:])]
        if pile:
            yield out()

    return run


def _collapsed(shared):
    """Equal texts of a map task as one row: count, most code points, the smallest id of those. Texts that the filter rules out are absent."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        size = 0

        def out() -> pa.RecordBatch:
            rows = list(zip(*held.values(), strict=True)) or [(), (), (), ()]
            return pa.RecordBatch.from_arrays([pa.array(rows[3], pa.int64()), pa.array(list(held), pa.binary()), *[pa.array(x, pa.int64()) for x in rows[:3]]], ["fp", "bytes", "n", "chars", "id"])

        for batch in batches:
            texts = [normal(x) for x in batch["text"].cast(pa.binary()).to_pylist()]
            fps = np.array([xxhash.xxh3_64_intdigest(x) for x in texts], np.uint64).view(np.int64)
            ids, lengths = batch["_id"].to_pylist(), batch["n"].to_pylist()
            for k in np.flatnonzero(may_hold(shared.value, fps)).tolist():
                i, chars, key = ids[k], lengths[k], texts[k]
                if (old := held.get(key)) is None:
                    held[key] = [1, chars, i, int(fps[k])]
                    size += len(key) + 200
                else:
                    old[0] += 1
                    if (-chars, i) < (-old[1], old[2]):
                        old[1:3] = chars, i
            if size > FLUSH_BYTES:
                yield out()
                held, size = {}, 0
        yield out()

    return run


def exact_groups(docs: DataFrame, block_bits: int | None = None, quotient_bits: int = 8) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    spark = docs.sparkSession
    arrow_rows(spark)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.length(text).cast("long").alias("n"), text.alias("text"))
    digest = staged(map_arrow(rows.withColumn("tag", F.monotonically_increasing_id()), "exact", _digests, "_id long, n long, tag long, fp long, sha binary"), "digest")
    n = parts(spark)
    bits = max(1, (4 * n - 1).bit_length()) if block_bits is None else block_bits
    filters = map_arrow(digest.select("fp"), "exact", _filters(bits, quotient_bits), "block long, filter binary")
    repeated = staged(map_arrow(filters.repartition(n, "block").sortWithinPartitions("block"), "exact", _repeated(bits), "fp long, seen long"), "repeated")
    shared = spark.sparkContext.broadcast(fixed_filter(repeated, "fp"))
    texts = map_arrow(rows, "exact", _collapsed(shared), "fp long, bytes binary, n long, chars long, id long")
    same = texts.join(repeated, "fp", "left_semi").groupBy("fp", "bytes").agg(F.sum("n").alias("group_size"), F.max(F.struct("chars", F.bitwise_not("id").alias("id"))).alias("top"))
    best = same.select("fp", F.unhex(F.sha2("bytes", 256)).alias("sha"), "group_size", F.col("top.chars").alias("k_n"), F.bitwise_not("top.id").alias("k_id")).where("group_size > 1")
    best = staged(best, "best")
    # Rows that repeat the keeper in full: the least tag of them stays (partial aggregates; a keeper that is alone has one).
    keepers = digest.join(best.select("fp", "sha", F.col("k_n").alias("n"), F.col("k_id").alias("_id")), ["fp", "sha", "n", "_id"]).groupBy("fp", "sha").agg(F.min("tag").alias("k_tag"))
    known = staged(best.join(keepers, ["fp", "sha"]), "keepers")  # read back, so that AQE may split the join below where a text is hot
    out = digest.join(known, ["fp", "sha"], "left")
    keep = F.coalesce("k_id", "_id")
    null = lambda c: F.when(c != F.lit(LAST_ID), c)
    return out.select(null(F.col("_id")).alias("doc_id"), null(keep).alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"), F.coalesce(F.col("k_tag") == F.col("tag"), F.lit(True)).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))
