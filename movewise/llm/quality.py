"""Quality rules (operator 2): repetition coverage.

Rolling hashes of word n-grams of several lengths, in numpy over a run of texts at a time, find the
n-grams that a document repeats; what counts is the share of its word characters inside all their
occurrences (once per character), or inside all those of the most frequent n-gram, with the limits of
Rae et al. (2021), and inside the later copies of repeated lines. Two line rules differ from theirs: a
single repeated line does not count towards the share of lines, and the characters of later copies may
be 0.30 of a text, not 0.20. Short texts and texts whose 3-word windows mostly repeat fail beforehand.

Words and n-grams are told apart by 64-bit hashes; lines by their bytes.

Scale: one pass over the texts, no shuffle, memory of a run of about a megabyte of text. A longer text
is a run of its own and takes some fifteen times its size.

Cases: null and empty texts have no word and fail; an empty table gives an empty report. Everything is
measured within a row, so ties, repeated rows and clashing column names do not matter;
``quality_filter`` returns its rows unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_rows, identified, map_arrow, mix, real_id, slices, utf8, word_hashes, words


@dataclass(frozen=True)
class Limits:
    """What a text may hold at most: its share of characters by n-gram length, its share of repeated lines and of their characters."""

    in_top: dict[int, float] = field(default_factory=lambda: {2: 0.20, 3: 0.18, 4: 0.16})
    in_repeated: dict[int, float] = field(default_factory=lambda: {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10})
    lines: float = 0.30
    line_chars: float = 0.30


LEAST_WORDS, MOST_REPEAT_PERCENT = 50, 50
_ROLL = np.uint64(0x9E3779B97F4A7C15)
_SYMBOL = np.zeros(256, bool)
_SYMBOL[np.frombuffer(b"#*$%&|<>", np.uint8)] = True


def _per_doc(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Sums of values[off[i]:off[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[off[1:]] - total[off[:-1]]


def _groups(key: np.ndarray) -> np.ndarray:
    """For each entry how many have its key."""
    order = np.argsort(key)
    k = key[order]
    number = np.empty(len(k), np.int64)
    number[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]]) - 1 if len(k) else 0
    return np.bincount(number)[number] if len(k) else number


def _covered(hit: np.ndarray, n: int, size: int) -> np.ndarray:
    """Words inside the n-word windows that start at the given words."""
    edge = np.zeros(size + 1, np.int32)
    edge += np.bincount(hit, minlength=size + 1).astype(np.int32)
    edge -= np.bincount(np.minimum(hit + n, size), minlength=size + 1).astype(np.int32)
    return np.cumsum(edge[:size]) > 0


def measure(off: np.ndarray, data: np.ndarray, limits: Limits) -> dict[str, np.ndarray]:
    """The base numbers and the coverages of a run of texts."""
    start, end, first = words(off, data)
    n_docs, n_words = len(off) - 1, np.diff(first)
    doc = np.repeat(np.arange(n_docs), n_words)
    point = np.append((data & 0xC0) != 0x80, False)
    chars = np.add.reduceat(point, np.column_stack([start, end]).ravel(), dtype=np.int64)[::2] if len(start) else np.zeros(0, np.int64)
    out = {"n_words": n_words, "word_chars": _per_doc(chars, first), "n_symbols": _per_doc(_SYMBOL[data], off)}
    raw = data.tobytes()
    # Lines, by their bytes; a line counts if it has a word.
    dup_lines, all_lines, dup_chars = np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64), np.zeros(n_docs, np.int64)
    for i in range(n_docs):
        had: set[bytes] = set()
        for line in raw[off[i] : off[i + 1]].split(b"\n"):
            if parts := line.split():
                all_lines[i] += 1
                if line in had:
                    dup_lines[i] += 1
                    dup_chars[i] += sum(len(w) if w.isascii() else len(w.decode()) for w in parts)
                else:
                    had.add(line)
    out |= {"n_dup_lines": dup_lines}
    # Rolling hashes of words, started with the number of the document, so that equal keys are of one document.
    inside = lambda n: np.flatnonzero(doc[n - 1 :] == doc[: len(doc) - n + 1]) if len(doc) >= n else np.zeros(0, np.int64)
    total = np.maximum(out["word_chars"], 1)
    bad = ((dup_lines > 1) & (dup_lines > limits.lines * np.maximum(all_lines, 1))) | (dup_chars > limits.line_chars * total)
    coverage, out["n_repeat_words"] = np.zeros(n_docs), np.zeros(n_docs, np.int64)
    word = word_hashes(data, start, end)
    own = mix(doc.astype(np.uint64) + np.uint64(1))
    roll, done = word, 1
    for n in sorted({3} | limits.in_top.keys() | limits.in_repeated.keys()):
        with np.errstate(over="ignore"):
            while done < n and len(roll) > 1:
                roll = roll[:-1] * _ROLL + word[done:]
                done += 1
        at = inside(n)
        if not len(at):
            continue
        count = _groups(mix(roll[at] ^ own[at]))
        repeated = count > 1
        if not repeated.any():
            continue
        covered = _covered(at[repeated], n, len(word))
        if n == 3:
            out["n_repeat_words"] = _per_doc(covered, first)
        if n in limits.in_repeated:
            share = _per_doc(chars * covered, first) / total
            bad |= share > limits.in_repeated[n]
            coverage = np.maximum(coverage, share)
        if n in limits.in_top:
            size = np.convolve(chars, np.ones(n, np.int64), "valid")[at] * count
            best = np.zeros(n_docs, np.int64)
            np.maximum.at(best, doc[at[repeated]], size[repeated])
            bad |= best / total > limits.in_top[n]
    out["base_failed"] = (n_words < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEAT_PERCENT * n_words)
    out["kept"] = ~out["base_failed"] & ~bad
    out["coverage"] = coverage
    out["line_coverage"] = dup_chars / total
    return out


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "coverage": "double", "line_coverage": "double"}


def _measured(column: pa.Array, limits: Limits) -> dict[str, np.ndarray]:
    off, data = utf8(column)
    runs = [measure(off[i : j + 1] - off[i], data[off[i] : off[j]], limits) for i, j in slices(off)]
    return {c: np.concatenate([r[c] for r in runs]) if runs else np.zeros(0, bool if t == "boolean" else float if t == "double" else np.int64) for c, t in COLUMNS.items()}


def quality_report(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """One row per document: doc_id, the base numbers, base_failed, kept, coverage, line_coverage."""
    limits = limits or Limits()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["_id"], *[pa.array(x) for x in _measured(batch["text"], limits).values()]], ["_id", *COLUMNS])

    rows = identified(docs).select("_id", "text")
    return map_arrow(rows, "quality", run, "_id long, " + ", ".join(f"{c} {t}" for c, t in COLUMNS.items())).select(real_id(), *COLUMNS)


def quality_filter(docs: DataFrame, limits: Limits | None = None) -> DataFrame:
    """The rows of docs that the rules keep, unchanged."""
    limits = limits or Limits()
    arrow_rows(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_measured(batch.column(at), limits)["kept"]))

    return map_arrow(docs, "quality", run, docs.schema)
