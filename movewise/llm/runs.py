"""Periodic run detection (operator 11): Main-Lorentz divide and conquer on interned word ids.

A run is a maximal stretch of words with smallest period q, at least ``least`` words long and ``times``
periods. A text is halved again and again; at each midpoint the Z-functions of the halves, of the
reversed halves and of each half against the whole give, for every period, how far it holds to both
sides. A stretch that its segment cuts short is left to the segment above, whose midpoint it crosses in
full; of several periods of one interval the smallest is kept.

Only texts and segments that repeat an n-gram are halved: a run of length l and period q agrees with
itself over l - q words, which is at least ``gram(least, times)`` of them, so a segment where no such
n-gram occurs again in its text holds no run. N-grams are told apart by hashes there, which can only let
more segments through; runs are found on interned words.

Scale: one pass over the texts, no shuffle, memory of a run of about a megabyte of text and of the
largest text (some thirty times its size while it is searched). O(n log n) steps for a text of n words.

Cases: null and empty texts, and texts without a word, have no run, and hash as the empty string.
Everything is measured within a row, so repeated rows, ties between documents and clashing column names
do not matter. Ties between runs of one text go to the smallest start, then to the smallest period.
Very long texts are searched whole. A null doc_id stays null. An empty table gives an empty report.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, map_arrow, mix, rolled, slices, utf8, word_hashes, words

LEAST, TIMES = 24, 3
#: (document as read, number of words) -> where copying begins, and its period; None leaves the words as they are.
Rewrite = Callable[[int | None, int], tuple[int, int] | None]


def gram(least: int, times: int) -> int:
    """Over how many words a run agrees with itself one period further, at least."""
    edge = least // times
    return max(1, min(least - edge, (times - 1) * (edge + 1)))


def z_prefix(s: list[int], stop: int) -> list[int]:
    """Z-function of s at its first `stop` positions: how many words from each position equal those from the start."""
    n = len(s)
    z = [0] * stop
    if stop:
        z[0] = n
    left = right = 0
    for i in range(1, stop):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def z_match(pattern: list[int], z: list[int], text: list[int], begin: int, stop: int) -> list[int]:
    """How many words from each of text[begin:stop] equal those from the start of the pattern, whose Z-function is z."""
    m, n = len(pattern), len(text)
    out = [0] * (stop - begin)
    left = right = begin
    for i in range(begin, stop):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                out[i - begin] = k
                continue
            k = right - i
        while k < m and i + k < n and pattern[k] == text[i + k]:
            k += 1
        out[i - begin] = k
        if i + k > right:
            left, right = i, i + k
    return out


def crossing(ids: list[int], low: int, mid: int, high: int, least: int, times: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, period) of repetitions around mid inside [low, high), as far as the segment goes."""
    most = (high - low) // times
    right, left = ids[mid:high], ids[low:mid][::-1]
    whole, mirrored = ids[low:high], ids[low:high][::-1]
    z_right, z_left = z_prefix(right, len(right)), z_prefix(left, len(left))
    need = lambda p: max(least, times * p)
    # Periods whose copy lies right of the midpoint: [mid, mid + p) is inside.
    top = min(most, len(right) - 1)
    if top > 0:
        back = z_match(left, z_left, mirrored, high - mid - top, high - mid)  # ends at mid + p - 1, for p = top ... 1
        for p in range(1, top + 1):
            before, after = back[top - p], z_right[p]
            if before + after + p >= need(p):
                yield mid - before, mid + p + after, p
    top = min(most, len(right))
    if top == len(right) and top > 0:  # the copy ends with the segment
        before = z_match(left, z_left, mirrored, 0, 1)[0]
        if before + top >= need(top):
            yield mid - before, high, top
    # Periods whose copy lies left of it: [mid - p, mid) is inside.
    top = min(most, len(left))
    if top > 0:
        ahead = z_match(right, z_right, whole, mid - top - low, mid - low)  # begins at mid - p, for p = top ... 1
        for p in range(1, top + 1):
            before, after = (z_left[p] if p < len(left) else 0), ahead[top - p]
            if before + after + p >= need(p):
                yield mid - p - before, mid + after, p


def runs(ids: list[int], least: int = LEAST, times: int = TIMES, again: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, sorted. again: where an n-gram of gram(least, times) words begins that the text repeats."""
    n = len(ids)
    best: dict[tuple[int, int], int] = {}
    ahead = None if again is None else np.concatenate([[0], np.cumsum(again)]).tolist()
    stack = [(0, n)]
    while stack:
        low, high = stack.pop()
        if high - low < least or ahead is not None and ahead[min(high, len(ahead) - 1)] == ahead[min(low, len(ahead) - 1)]:
            continue
        mid = (low + high) // 2
        for s, e, p in crossing(ids, low, mid, high, least, times):
            if s == low and low > 0 and ids[low - 1] == ids[low - 1 + p] or e == high and high < n and ids[high] == ids[high - p]:
                continue  # goes on beyond this segment: found above in full
            if p < best.get((s, e), p + 1):
                best[s, e] = p
        stack += [(low, mid), (mid, high)]
    return sorted((s, e - s, p) for (s, e), p in best.items())


def collapsed(tokens: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without those that any run contains after its first period."""
    edge = [0] * (len(tokens) + 1)
    for s, length, p in found:
        edge[s + p] += 1
        edge[s + length] -= 1
    out, depth = [], 0
    for token, step in zip(tokens, edge, strict=False):
        depth += step
        if not depth:
            out.append(token)
    return out


def planted(doc: int | None, n: int) -> tuple[int, int] | None:
    """Test runs in one document of ten: words from a on repeat the p words there, as a hash of the document's number says. None without a number."""
    if doc is None or n == 0:
        return None
    h = zlib.crc32(str(doc).encode())
    g = h // 10
    if h % 10:
        return None
    return g % n, 1 + (n - g % n) // (3 + g % 8)


def _source(doc: np.ndarray, first: np.ndarray, at: list[tuple[int, int] | None]) -> np.ndarray:
    """For each word of a run of texts the word that stands there after rewriting."""
    out = np.arange(len(doc))
    for i, change in enumerate(at):
        if change is not None:
            a, p = first[i] + change[0], change[1]
            out[a : first[i + 1]] = a + np.arange(first[i + 1] - a) % p
    return out


def _again(key: np.ndarray) -> np.ndarray:
    """Which keys occur more than once."""
    order = np.argsort(key)
    k = key[order]
    same = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def search(off: np.ndarray, data: np.ndarray, ids: list[int | None], least: int, times: int, rewrite: Rewrite | None) -> Iterator[tuple[list[bytes], list[tuple[int, int, int]]]]:
    """Words (rewritten, if so) and runs of each text of a run of texts."""
    start, end, first = words(off, data)
    doc = np.repeat(np.arange(len(off) - 1), np.diff(first))
    change = [rewrite(i, int(n)) if rewrite else None for i, n in zip(ids, np.diff(first), strict=True)]
    size = gram(least, times)
    hashed = word_hashes(data, start, end)[_source(doc, first, change)]
    if len(hashed) >= size:
        own = mix(doc.astype(np.uint64) + np.uint64(1))
        again = _again(mix(rolled(hashed, size) ^ own[: len(doc) - size + 1])) & (doc[size - 1 :] == doc[: len(doc) - size + 1])
    else:
        again = np.zeros(0, bool)
    raw = data.tobytes()
    for i, at in enumerate(change):
        tokens = raw[off[i] : off[i + 1]].split()
        if at is not None:
            a, p = at
            n = len(tokens)
            tokens[a:] = (tokens[a : a + p] * (-(-(n - a) // p)))[: n - a]
        here = again[first[i] : max(first[i], first[i + 1] - size + 1)]
        if not here.any():
            yield tokens, []
            continue
        number: dict[bytes, int] = {}
        yield tokens, runs([number.setdefault(t, len(number)) for t in tokens], least, times, here)


REPORT = {"n_runs": "long", "start": "long", "length": "long", "period": "long", "exponent_milli": "long", "runs_sha256": "string", "collapsed_sha256": "string"}


def _summary(tokens: list[bytes], found: list[tuple[int, int, int]]) -> tuple:
    listed = hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in found).encode()).hexdigest()
    kept = hashlib.sha256(b" ".join(collapsed(tokens, found) if found else tokens)).hexdigest()
    if not found:
        return 0, None, None, None, None, listed, kept
    top = found[0]
    for run in found[1:]:
        if run[1] * top[2] > top[1] * run[2]:  # length / period, exactly; earlier ones win ties
            top = run
    return len(found), *top, 1000 * top[1] // top[2], listed, kept


def _texts(docs: DataFrame) -> DataFrame:
    arrow_rows(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))


def _searched(batch: pa.RecordBatch, least: int, times: int, rewrite: Rewrite | None) -> Iterator[tuple[int | None, list[bytes], list[tuple[int, int, int]]]]:
    off, data = utf8(batch["text"])
    ids = batch["doc_id"].to_pylist()
    for i, j in slices(off):
        yield from zip(ids[i:j], *zip(*search(off[i : j + 1] - off[i], data[off[i] : off[j]], ids[i:j], least, times, rewrite), strict=True), strict=True)


def run_report(docs: DataFrame, least: int = LEAST, times: int = TIMES, rewrite: Rewrite | None = None) -> DataFrame:
    """One row per document: doc_id, n_runs, the run with most periods, digests of all runs and of the words that stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, *_summary(tokens, found)) for i, tokens, found in _searched(batch, least, times, rewrite)]
            columns = list(zip(*rows, strict=True)) or [()] * (1 + len(REPORT))
            types = [pa.int64() if t == "long" else pa.string() for t in ("long", *REPORT.values())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", *REPORT])

    return map_arrow(_texts(docs), "runs", run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in REPORT.items()))


def run_spans(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """One row per run: doc_id, start (word number), length, period and the words of its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, s, n, p, b" ".join(tokens[s : s + p]).decode()) for i, tokens, found in _searched(batch, least, times, None) for s, n, p in found]
            columns = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns[:4]], pa.array(columns[4], pa.string())], ["doc_id", "start", "length", "period", "unit"])

    return map_arrow(_texts(docs), "runs", run, "doc_id long, start long, length long, period long, unit string")


def collapse_runs(docs: DataFrame, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """docs with every run in text cut to its first period; words are then joined by one space. Texts without a run, and other columns, are unchanged."""
    arrow_rows(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            plain = pa.RecordBatch.from_arrays([pa.nulls(len(batch), pa.int64()), batch.column(at)], ["doc_id", "text"])
            for i, (_, tokens, found) in enumerate(_searched(plain, least, times, None)):
                if found:
                    texts[i] = b" ".join(collapsed(tokens, found)).decode()
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, batch.column(at).type), *batch.columns[at + 1 :]], batch.schema.names)

    return map_arrow(docs, "runs", run, docs.schema)
