"""Ranked lexical search (operator 13): MaxScore per shard.

For each item the documents with the highest integer BM25-like scores. Terms are those of
``terms.terms``; an item asks for each of its terms once. What a shard holds is inverted: for each term
that any item asks for, its documents and what it adds to their scores. The largest addition is the
term's upper bound in the shard. An item's terms in ascending order of bounds fall into non-essential
ones, whose bounds together stay below the k-th best score so far, and essential ones. Only documents
of essential postings are candidates; non-essential postings, largest bound first, are probed only for
candidates that can still reach that score. A task goes from shard to shard with its best k of each item.

Scale: two passes. The first reads the texts once and writes, for each document, the asked terms in it
with their frequencies (a few numbers each). Statistics are Spark aggregates of that table: N and L are
one row, document frequencies one row for each asked term. The second pass reads it, a batch of Arrow
rows being a shard, and gives at most k rows for each item from each task; a window limited to k before
and after its shuffle ranks them. A hot term makes no hot task, since postings never leave the task that
reads their document. Items are collected in blocks of about BLOCK pairs of item and term, each block
with two passes of its own, so nothing on the driver or in a broadcast grows with the items, but for a
single item with more terms than that.

Cases: a null or empty text, or one without a term, is no document of the statistics and is never
returned; an item without terms has no rows. Items that repeat an item_id are one item with the terms of
all of them; a null item_id is an item too. Each row of documents counts, also where rows repeat. Equal
scores go by ascending doc_id, null last; repeated rows take ranks after each other. Very long texts are
read whole. Empty tables give an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, map_arrow, staged
from .terms import terms

TOP = 10
#: Pairs of item and term that are searched at once.
BLOCK = 500_000


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term) once each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for i, text in zip(batch["item_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                mine = sorted(set(terms(text or b"")))
                ids += [i] * len(mine)
                found += mine
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.binary()).cast(pa.string())], ["item_id", "term"])

    arrow_rows(items.sparkSession)
    return map_arrow(items.select(F.col("item_id").cast("long").alias("item_id"), "text"), "lexical", run, "item_id long, term string").distinct()


def forward(docs: DataFrame, asked) -> DataFrame:
    """(doc_id, n, terms, freqs) of each row with a term: its length, and numbers and frequencies of the asked terms in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[bytes, int] = asked.value
        for batch in batches:
            ids, size, found, freq, off = [], [], [], [], [0]
            for i, text in zip(batch["doc_id"].to_pylist(), batch["text"].cast(pa.binary()).to_pylist(), strict=True):
                mine = terms(text or b"")
                if not mine:
                    continue
                counts = Counter(mine)
                hit = number.keys() & counts.keys()
                ids.append(i)
                size.append(len(mine))
                found += [number[t] for t in hit]
                freq += [counts[t] for t in hit]
                off.append(len(found))
            lists = [pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(x, pa.int32())) for x in (found, freq)]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(size, pa.int64()), *lists], ["doc_id", "n", "terms", "freqs"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return map_arrow(rows, "lexical", run, "doc_id long, n long, terms array<int>, freqs array<int>")


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def length_norm(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """m of documents of n terms: 10 + (90 n N) div L."""
    if len(n) and 90 * int(n.max()) * n_docs >= 1 << 63:
        return np.array([10 + 90 * int(x) * n_docs // n_terms for x in n], np.int64)
    return 10 + 90 * n * n_docs // n_terms


@dataclass
class Shard:
    """Postings of a run of documents: of each term the documents, ascending, what it adds to their scores, and its upper bound."""

    size: int
    docs: dict[int, np.ndarray]
    adds: dict[int, np.ndarray]
    bound: dict[int, int]

    @classmethod
    def of(cls, n: np.ndarray, lengths: np.ndarray, found: np.ndarray, freq: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int) -> Shard:
        doc = np.repeat(np.arange(len(n)), lengths)
        m = length_norm(n, n_docs, n_terms)[doc]
        tf = freq.astype(np.int64)
        adds = weight[found] * (1_000_000_000 * tf // (1000 * tf + 8 * m))
        order = np.argsort(found, kind="stable")
        term, doc, adds = found[order], doc[order], adds[order]
        begin = np.flatnonzero(np.r_[True, term[1:] != term[:-1]]) if len(term) else np.zeros(0, np.int64)
        names, cuts = term[begin].tolist(), begin[1:]
        most = np.maximum.reduceat(adds, begin).tolist() if len(begin) else []
        return cls(len(n), dict(zip(names, np.split(doc, cuts), strict=False)), dict(zip(names, np.split(adds, cuts), strict=False)), dict(zip(names, most, strict=False)))

    def candidates(self, wanted: list[int], least: int) -> tuple[np.ndarray, np.ndarray]:
        """Documents (ascending) with a score of `least` or more, and the scores; MaxScore."""
        mine = sorted((t for t in wanted if t in self.bound), key=self.bound.__getitem__)
        reach, total = [], 0
        for t in mine:
            total += self.bound[t]
            reach.append(total)
        if total < least:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        essential = next(i for i, r in enumerate(reach) if r >= least) if mine else 0
        score = np.zeros(self.size, np.int64)
        for t in mine[essential:]:
            score[self.docs[t]] += self.adds[t]
        at = np.flatnonzero(score)
        got = score[at]
        for i in range(essential - 1, -1, -1):
            able = got + reach[i] >= least
            at, got = at[able], got[able]
            if not len(at):
                break
            posting = self.docs[mine[i]]
            place = np.minimum(np.searchsorted(posting, at), len(posting) - 1)
            got = got + np.where(posting[place] == at, self.adds[mine[i]][place], 0)
        good = got >= least
        return at[good], got[good]


class Best:
    """The best k of an item so far: score descending, then doc_id ascending, null last."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.score, self.missing, self.doc = np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)

    @property
    def least(self) -> int:
        """What a document must score to be looked at."""
        return max(1, int(self.score[-1])) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, missing: np.ndarray, doc: np.ndarray) -> None:
        score, missing, doc = np.concatenate([self.score, score]), np.concatenate([self.missing, missing]), np.concatenate([self.doc, doc])
        order = np.lexsort((doc, missing, -score))[: self.k]
        self.score, self.missing, self.doc = score[order], missing[order], doc[order]


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, weight, n_docs, n_terms = shared.value
        best: dict[int, Best] = {}
        for batch in batches:
            n = batch["n"].to_numpy(zero_copy_only=False)
            lengths = batch["terms"].value_lengths().to_numpy(zero_copy_only=False)
            found, freq = (batch[c].flatten().to_numpy(zero_copy_only=False) for c in ("terms", "freqs"))
            doc = batch["doc_id"].fill_null(0).to_numpy(zero_copy_only=False)
            missing = batch["doc_id"].is_null().to_numpy(zero_copy_only=False)
            shard = Shard.of(n, lengths, found, freq, weight, n_docs, n_terms)
            for i, (_, wanted) in enumerate(items):
                held = best.get(i) or Best(k)
                at, score = shard.candidates(wanted, held.least)
                if len(at):
                    held.add(score, missing[at], doc[at])
                    best[i] = held
        item, doc, score = [], [], []
        for i, held in best.items():
            item += [items[i][0]] * len(held.score)
            doc += [None if gone else d for d, gone in zip(held.doc.tolist(), held.missing.tolist(), strict=True)]
            score += held.score.tolist()
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (item, doc, score)], ["item_id", "doc_id", "score"])

    return run


def rank(docs: DataFrame, items: DataFrame, k: int = TOP, block: int = BLOCK) -> DataFrame:
    """item_id, rank, doc_id, score: the k best documents of every item."""
    spark = docs.sparkSession
    arrow_rows(spark)
    pairs = staged(item_terms(items), "items")
    blocks = max(1, -(-pairs.count() // block))
    found = [_ranked_block(docs, pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else pairs, k) for b in range(blocks)]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _ranked_block(docs: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    spark = docs.sparkSession
    wanted: dict[int | None, list[int]] = {}
    number: dict[bytes, int] = {}
    for r in pairs.collect():  # about BLOCK pairs
        wanted.setdefault(r["item_id"], []).append(number.setdefault(r["term"].encode(), len(number)))
    rows = staged(forward(docs, spark.sparkContext.broadcast(number)), "forward")
    total = rows.agg(F.count("*").alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    weight = np.zeros(len(number), np.int64)
    for r in rows.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # one row for each asked term
        weight[r["t"]] = term_weight(total["docs"], r["count"])
    shared = spark.sparkContext.broadcast((list(wanted.items()), weight, total["docs"], total["terms"]))
    return map_arrow(rows, "lexical", _search(shared, k), "item_id long, doc_id long, score long")
