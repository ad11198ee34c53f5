"""Substring dedup (operator 6): super-k-mer partitioning of 50-word windows.

A window's minimiser is its smallest 5-word hash. Consecutive windows with the same minimiser travel
as one packed string (a super-k-mer) to the bucket of that minimiser, so equal windows of all
documents meet; there, sorting brings equal windows together and counts them exactly. A word goes if
a window over it also starts in a document with a smaller doc_id.

Scale. Hashes that are common in the corpus come last in the order of minimisers (levels of a fixed
size sketch), so a passage that many documents share draws only the windows that lie inside it to its
bucket, not those around it. A minimiser so common that it would fill a good part of a bucket does not
name its bucket alone, but together with the largest hash of the window, which spreads its windows;
equal windows still meet. Windows that repeat inside a map task's run of texts are settled there
and do not travel again, which leaves one copy per run for the hottest passage. Super-k-mers of a
bucket are compressed together. Partitions and buckets are as many as the number of words asks for;
buckets are processed one by one, in memory of the size of a bucket. Texts meet their spans in a join
that only texts enter whose key a fixed-size bitmap has seen.

Cases: null and short texts have no window and lose nothing. A null doc_id ranks after all others.
Windows that repeat within one document, or in rows that repeat a doc_id, do not count against each
other. Of several smaller documents any one counts, so there are no ties. A very long text is cut as a
run of its own, in some thirty times its size. An empty table gives an empty one. Extra columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, fixed_filter, frequency_levels, let_through, map_arrow, mix, parts, ranked, rolled, slices, span_hash, staged, utf8, word_hashes, words

LAST_ID = 2**63 - 1
WINDOW, MER = 50, 5
#: Bytes of text that a map task cuts at once.
RUN_BYTES = 4 << 20
#: Words that a shuffle partition and a bucket should hold.
PARTITION_WORDS, BUCKET_WORDS = 6_000_000, 500_000


class Run:
    """Words of a run of texts: canonical bytes (one blank after each word), hashes, text numbers."""

    def __init__(self, off: np.ndarray, data: np.ndarray) -> None:
        start, end, self.first = words(off, data)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))
        self.hash = word_hashes(data, start, end)
        length = end - start
        self.pos = np.r_[0, np.cumsum(length + 1)]
        solid = np.ones(int(self.pos[-1]), bool)
        solid[self.pos[1:] - 1] = False
        text = np.full(len(solid), 32, np.uint8)
        inside = np.zeros(len(data) + 1, np.int8)
        inside[start] += 1
        inside[end] -= 1
        text[solid] = data[np.cumsum(inside[:-1]) > 0] if len(data) else 0
        self.bytes = text.tobytes()

    def windows(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and hash of each window that lies in one text."""
        n = len(self.doc) - WINDOW + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        at = np.flatnonzero(self.doc[:n] == self.doc[WINDOW - 1 :])
        return at, span_hash(self.hash, at, at + WINDOW)

    def window(self, at: int) -> bytes:
        return self.bytes[self.pos[at] : self.pos[at + WINDOW] - 1]

    def smallest(self, at: np.ndarray, h: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """For each window the smallest id (ids: one per text) of any text with the same window, by sorting.

        Sorted by hash; windows whose neighbours have the hash and another id are compared byte by byte.
        """
        own = ids[self.doc[at]]
        out = own.copy()
        if not len(at):
            return out
        order = np.argsort(h, kind="stable")
        hs = h[order]
        head = np.flatnonzero(np.r_[True, hs[1:] != hs[:-1]])
        size = np.diff(np.r_[head, len(hs)])
        ordered = own[order]
        low, high = np.minimum.reduceat(ordered, head), np.maximum.reduceat(ordered, head)
        for a, n in zip(head[low != high].tolist(), size[low != high].tolist(), strict=True):
            group = order[a : a + n]
            text = [self.window(x) for x in at[group].tolist()]
            if text.count(text[0]) == n:
                out[group] = own[group].min()
            else:  # a hash that two texts share: group by the bytes themselves
                least: dict[bytes, int] = {}
                for t, i in zip(text, own[group].tolist(), strict=True):
                    least[t] = min(i, least.get(t, i))
                out[group] = [least[t] for t in text]
        return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minima of x[i:i + width], by doubling."""
    out, have = x, 1
    while have * 2 <= width:
        out = np.minimum(out[: len(out) - have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _merge(doc: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Covered words [a, b) of flagged windows (in order): overlapping and adjacent ones joined."""
    if not len(first):
        return doc, first, first
    new = np.r_[True, (doc[1:] != doc[:-1]) | (first[1:] > first[:-1] + WINDOW)]
    head = np.flatnonzero(new)
    last = np.r_[head[1:], len(first)] - 1
    return doc[head], first[head], first[last] + WINDOW


def _text_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about RUN_BYTES: ids, text keys, offsets, bytes."""
    for batch in batches:
        off, data = utf8(batch["text"])
        ids, tks = (batch[c].to_numpy(zero_copy_only=False) for c in ("_id", "_tk"))
        for i, j in slices(off, RUN_BYTES):
            yield ids[i:j], tks[i:j], off[i : j + 1] - off[i], data[off[i] : off[j]]


def _mers(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    for _, _, off, data in _text_runs(iter([batch])):
        run = Run(off, data)
        if len(run.doc) >= MER:
            h = rolled(run.hash, MER)
            yield h[run.doc[: len(h)] == run.doc[MER - 1 :]]


def _super_kmers(levels, hot: int, buckets: int):
    """Blobs by bucket: ids, text keys, first words, and the strings of super-k-mers; settled spans ride along.

    Minimisers of level `hot` or more name a bucket together with the largest hash of the window.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=1).compress
        for number, (ids, tks, off, data) in enumerate(_text_runs(batches)):
            run = Run(off, data)
            at, h = run.windows()
            if not len(at):
                continue
            settled = run.smallest(at, h, ids) < ids[run.doc[at]]
            doc, a, b = _merge(run.doc[at[settled]], at[settled])
            gone = [ids[doc], tks[doc], a - run.first[doc], b - run.first[doc]]
            at = at[~settled]
            low = np.zeros(0, np.uint64)
            if len(at):
                mers = rolled(run.hash, MER)
                low = sliding_min(ranked(mers, levels.value), WINDOW - MER + 1)[at]
                common = low >> np.uint64(60) >= np.uint64(hot)
                if common.any():
                    low = np.where(common, mix(low ^ sliding_min(~mers, WINDOW - MER + 1)[at]), low)
            head = np.flatnonzero(np.r_[True, (low[1:] != low[:-1]) | (at[1:] != at[:-1] + 1)]) if len(at) else np.zeros(0, np.int64)
            first = at[head]
            last = at[np.r_[head[1:], len(at)] - 1] + WINDOW if len(at) else first
            bucket = (mix(low[head]) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.r_[True, np.diff(bucket[order]) != 0]) if len(order) else np.zeros(0, np.int64)
            out_bucket, blobs = [], []
            for k, group in enumerate(np.split(order, edges[1:])) if len(order) else []:
                d = run.doc[first[group]]
                text = b"\n".join([run.bytes[x : y - 1] for x, y in zip(run.pos[first[group]].tolist(), run.pos[last[group]].tolist(), strict=True)])
                spans = gone if k == 0 else [x[:0] for x in gone]
                body = b"".join(x.astype(np.int64).tobytes() for x in (np.array([len(group), len(spans[0])]), ids[d], tks[d], first[group] - run.first[d], *spans)) + text
                out_bucket.append(int(bucket[group[0]]))
                blobs.append(pack(body))
            if not blobs and len(gone[0]):
                body = b"".join(x.astype(np.int64).tobytes() for x in (np.array([0, len(gone[0])]), *gone))
                out_bucket.append(number % buckets)
                blobs.append(pack(body))
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "blob"])

    return cut


SPANS = ["_id", "_tk", "first", "end"]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each bucket, whose blobs arrive together: covered words of windows with a smaller document."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    now, pile = None, []

    def out(ids, tks, first, end) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(tks), pa.array(first), pa.array(end)], SPANS)

    def bucket() -> Iterator[pa.RecordBatch]:
        columns: list[list[np.ndarray]] = [[], [], []]
        texts = []
        for blob in pile:
            body = unpack(blob)
            n, m = (int(x) for x in np.frombuffer(body, np.int64, 2))
            numbers = np.frombuffer(body, np.int64, 3 * n + 4 * m, 16)
            for c, x in zip(columns, numbers[: 3 * n].reshape(3, n), strict=True):
                c.append(x)
            if m:
                yield out(*numbers[3 * n :].reshape(4, m))
            if n:
                texts.append(body[16 + 8 * (3 * n + 4 * m) :])
        if not texts:
            return
        ids, tks, base = (np.concatenate(c) for c in columns)
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        run = Run(np.r_[0, np.flatnonzero(data == 10) + 1, len(data)], data)
        at, h = run.windows()
        flagged = at[run.smallest(at, h, ids) < ids[run.doc[at]]]
        doc, a, b = _merge(run.doc[flagged], flagged)
        shift = base[doc] - run.first[doc]
        yield out(ids[doc], tks[doc], a + shift, b + shift)

    for batch in batches:
        for b, blob in zip(batch["bucket"].to_pylist(), batch["blob"].to_pylist(), strict=True):
            if now is not None and b != now:
                yield from bucket()
                pile = []
            now = b
            pile.append(blob)
    if pile:
        yield from bucket()


def _rows(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text).alias("_tk"), text.alias("text"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(_id, _tk, first, end): words [first, end) that windows with a smaller document cover; spans may overlap."""
    spark = docs.sparkSession
    arrow_rows(spark)
    rows = _rows(docs)
    levels, limit, total = frequency_levels(rows, _mers)
    n = max(parts(spark), -(-total // PARTITION_WORDS))
    buckets = n * max(1, -(-total // (n * BUCKET_WORDS)))
    share = total / buckets / 4
    hot = 1 if share <= limit else 1 + math.ceil(math.log2(share / limit))
    packed = map_arrow(rows, "substring", _super_kmers(spark.sparkContext.broadcast(levels), hot, buckets), "bucket long, blob binary")
    return map_arrow(packed.repartition(n, "bucket").sortWithinPartitions("bucket"), "substring", _counted, "_id long, _tk long, first long, end long")


def cut_words(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[bytes], int]:
    """Kept words of a text, and how many it had."""
    all_words = text.split()
    if not spans:
        return all_words, len(all_words)
    edge = np.zeros(len(all_words) + 1, np.int64)
    for a, b in spans:
        edge[a] += 1
        edge[b] -= 1
    keep = np.cumsum(edge[:-1]) == 0
    return [w for w, k in zip(all_words, keep.tolist(), strict=True) if k], len(all_words)


def _reported(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, removed, sha = [], [], []
        spans = batch["spans"].to_pylist() if "spans" in batch.schema.names else [None] * len(batch)
        for text, own in zip(batch["text"].cast(pa.binary()).to_pylist(), spans, strict=True):
            kept, n = cut_words(text, [(s["first"], s["end"]) for s in own or ()])
            total.append(n)
            removed.append(n - len(kept))
            sha.append(hashlib.sha256(b" ".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch["_id"], pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(sha, pa.string())], ["_id", "n_words", "n_removed", "kept_sha256"])


def substring_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256."""
    spark = docs.sparkSession
    spans = staged(repeated_spans(docs), "spans")
    shared = spark.sparkContext.broadcast(fixed_filter(spans, "_tk"))

    rows, schema = _rows(docs), "_id long, _tk long, text string"
    whole = map_arrow(rows, "substring", lambda batches: _reported(let_through(shared, "_tk", False)(batches)), OUT)
    own = spans.groupBy("_id", "_tk").agg(F.collect_list(F.struct("first", "end")).alias("spans"))
    some = map_arrow(rows, "substring", let_through(shared, "_tk"), schema)
    cut = map_arrow(some.join(own, ["_id", "_tk"], "left").select("_id", "text", "spans"), "substring", _reported, OUT)
    return whole.unionByName(cut).select(F.when(F.col("_id") != F.lit(LAST_ID), F.col("_id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


OUT = "_id long, n_words long, n_removed long, kept_sha256 string"
