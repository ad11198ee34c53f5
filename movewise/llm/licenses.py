"""License scans (operator 12): ordered signature rules.

Hundreds of expressions (``license_rules``) run over a text's terms, joined by one space. A rule is tried
only where the text holds all its keywords, so most texts try none. Of overlapping detections one goes
where its interval lies within that of another of the same or a higher priority: higher priorities come
first, then longer intervals, then the order of the rules. Labels of what is left, and of the base phrases
that stand in the text, are the text's labels. The score is that of the surest detection left, and
BASE_SCORE where only a base phrase stands.

A detection can end in the middle of what a longer expression of another rule would read; then both stay.

Scale: one pass over the texts, no shuffle, memory of some five times the largest text in a batch.

Cases: null and empty texts have no word, no label and score 0. Everything is measured within a row, so
ties between documents, repeated rows and clashing column names do not matter; very long texts are read
whole; a null doc_id stays null; an empty table gives an empty report.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, kept, map_arrow
from .license_rules import KINDS, RULES
from .terms import terms

# The base phrases and their labels.
PHRASES = {b"gnu general public license": "gpl", b"apache license": "apache", b"cc by": "cc-by", b"mit license": "mit"}
BASE_SCORE = 0.5


@dataclass(frozen=True)
class Rule:
    number: int
    label: str
    priority: int
    score: float
    words: frozenset[bytes]
    expression: re.Pattern[bytes]


@dataclass(frozen=True)
class Detection:
    """Terms start to end (exclusive) that a rule matched."""

    start: int
    end: int
    rule: Rule


def parse_rules(text: str) -> list[Rule]:
    out = []
    for line in text.strip().splitlines():
        label, kind, words, expression = line.split("; ", 3)
        priority, score = KINDS[kind]
        out.append(Rule(len(out), label, priority, score, frozenset(words.encode().split()), re.compile(rb"(?<!\S)(?:" + expression.encode() + rb")(?!\S)")))
    return out


class Scanner:
    """Rules by one keyword each: the one that fewest rules have. A text that lacks it does not look at the rule."""

    def __init__(self, rules: list[Rule]) -> None:
        uses: dict[bytes, int] = {}
        for rule in rules:
            for word in rule.words:
                uses[word] = uses.get(word, 0) + 1
        self.by_word: dict[bytes, list[Rule]] = {}
        for rule in rules:
            self.by_word.setdefault(min(rule.words, key=lambda w: (uses[w], w)), []).append(rule)

    def candidates(self, held: set[bytes]) -> list[Rule]:
        """Rules all of whose keywords a text holds, in order."""
        return sorted((r for w in self.by_word.keys() & held for r in self.by_word[w] if r.words <= held), key=lambda r: r.number)

    def detections(self, words: list[bytes]) -> list[Detection]:
        """What is left after suppression, by start."""
        tried = self.candidates(set(words))
        if not tried:
            return []
        text = b" ".join(words)
        found = []
        for rule in tried:
            for hit in rule.expression.finditer(text):
                first = text.count(b" ", 0, hit.start())
                found.append(Detection(first, first + 1 + hit.group().count(b" "), rule))
        return suppressed(found)


def suppressed(found: list[Detection]) -> list[Detection]:
    """Detections that lie within no other of the same or a higher priority.

    Taken in the order of preference, one lies within an earlier one exactly where, of those that start no later, the furthest end reaches its own.
    """
    stay: list[Detection] = []
    starts: list[int] = []
    ends: list[int] = []  # of those at starts, growing strictly: one within another is not needed to judge the rest
    for d in sorted(found, key=lambda d: (-d.rule.priority, d.start - d.end, d.rule.number, d.start)):
        at = bisect_right(starts, d.start)
        if at and ends[at - 1] >= d.end:
            continue
        stay.append(d)
        low = bisect_left(starts, d.start)
        high = bisect_right(ends, d.end)
        starts[low : max(low, high)] = [d.start]
        ends[low : max(low, high)] = [d.end]
    return sorted(stay, key=lambda d: (d.start, d.end, d.rule.number))


@cache
def _scanner() -> Scanner:
    return Scanner(parse_rules(RULES))


def places(words: list[bytes]) -> dict[str, list[int]]:
    """Where each base phrase begins, by its label."""
    text = b" " + b" ".join(words) + b" "
    out: dict[str, list[int]] = {}
    for phrase, label in PHRASES.items():
        at, done, word = text.find(b" " + phrase + b" "), 0, -1
        while at >= 0:
            word += text.count(b" ", done, at + 1)
            done = at + 1
            out.setdefault(label, []).append(word)
            at = text.find(b" " + phrase + b" ", at + 1)
    return out


REPORT = {"n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double"}


def scan(text: bytes, scanner: Scanner) -> tuple:
    words = terms(text)
    base = places(words)
    at = [p for ps in base.values() for p in ps]
    found = scanner.detections(words)
    labels = sorted(base.keys() | {d.rule.label for d in found})
    score = max([d.rule.score for d in found] + [BASE_SCORE] * bool(base), default=0.0)
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(base)), ",".join(labels), score


def license_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places of base phrases, base_labels, labels, score."""
    types = [pa.int64(), *[{"long": pa.int64(), "string": pa.string(), "double": pa.float64()}[t] for t in REPORT.values()]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept("licenses", _scanner)
        for batch in batches:
            rows = [(i, *scan(text or b"", scanner)) for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True)]
            columns = list(zip(*rows, strict=True)) or [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", *REPORT])

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, "licenses", run, "doc_id long, " + ", ".join(f"{c} {t}" for c, t in REPORT.items()))


def license_spans(docs: DataFrame) -> DataFrame:
    """One row per detection left: doc_id, label, kind's priority, rule, first and last word, the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = kept("licenses", _scanner)
        for batch in batches:
            rows = []
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                words = terms(text or b"")
                rows += [(i, d.rule.label, d.rule.priority, d.rule.number, d.start, d.end - 1, b" ".join(words[d.start : d.end]).decode()) for d in scanner.detections(words)]
            columns = list(zip(*rows, strict=True)) or [()] * 7
            types = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["doc_id", "label", "priority", "rule", "first_word", "last_word", "words"])

    arrow_rows(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, "licenses", run, "doc_id long, label string, priority int, rule int, first_word long, last_word long, words string")
