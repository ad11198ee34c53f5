"""Language ID (operator 4): multilingual mixture inference by expectation-maximisation.

Training counts hashed letter 3-grams (bytes, A-Z lower-cased, other ASCII as a blank, a blank put
before and after each text) of every training document per language. A document is a mixture of languages: EM estimates the proportions
from its n-gram likelihoods, and languages leave one by one as long as the penalised likelihood
(half of ln n per language) does not fall. The prediction is the largest proportion of the set that
stays; score is that proportion.

Scale: counting is one pass with one partial row per task, language and n-gram, the model is
2**GRAM_BITS numbers per language whatever the input (128 kB), and prediction is one pass without a
shuffle. Languages are the distinct labels, all of them. Up to BLOCK of them are fitted at once; where there
are more, each block chooses its set for a text, and those sets meet in a last fit, so working memory does
not grow with the labels. More than MOST_LANGUAGES (a parameter of `train`; 256 MB of model in each worker)
are refused: such a column does not hold languages.

Cases: null text, or text without a letter, is `und` with score 0. A text with letters but without an
n-gram of its own gets the language with the most training rows, with the share of rows as score.
Without any training row every text is `und`. Ties go to the language first by name. Repeated rows and
null doc_ids are rows like others (a null doc_id counts as the empty text for the fold), very long texts
are read whole, empty tables give empty results. Extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows, map_arrow, slices, utf8

GRAM_BITS = 15
BLOCK, MOST_LANGUAGES = 128, 2048
#: Overlapping 3-grams tell the same letters three times; likelihoods count a third.
TEMPER = 1 / 3
_FOLD = np.full(256, 32, np.uint8)
_FOLD[128:] = np.arange(128, 256)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)


def grams(off: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and hashed 3-gram for each position of a run of texts (each between two blanks) whose 3 bytes are not all blank."""
    n = len(off) - 1
    padded = np.full(len(data) + 2 * n, 32, np.uint8)
    begin = off[:-1] + 2 * np.arange(n) + 1
    size = np.diff(off)
    padded[np.arange(len(data)) + np.repeat(begin - off[:-1], size)] = _FOLD[data]
    if len(padded) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    b = padded.astype(np.uint32)
    three = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    ok = three != 0x202020
    edge = (begin + size + 1)[:-1]
    for back in (1, 2):
        ok[edge[edge - back < len(ok)] - back] = False
    doc = np.repeat(np.arange(n), size + 2)[:-2]
    h = (three * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)
    return doc[ok], h[ok].astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial sums of a task: a row per language and n-gram, given out whenever a worker holds more than BLOCK languages."""
    total: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for name, row in total.items():
            at = np.flatnonzero(row)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(row[at])], ["lang", "gram", "n"])
        total.clear()

    for batch in batches:
        off, data = utf8(batch["text"])
        langs = batch["lang"].to_pylist()
        for i, j in slices(off):
            doc, gram = grams(off[i : j + 1] - off[i], data[off[i] : off[j]])
            names = sorted(set(langs[i:j]))
            place = {x: c for c, x in enumerate(names)}
            code = np.array([place[x] for x in langs[i:j]])
            count = np.bincount((code[doc] << GRAM_BITS) | gram, minlength=len(names) << GRAM_BITS).reshape(len(names), -1)
            for name, row in zip(names, count, strict=True):
                total[name] = total[name] + row if name in total else row
            if len(total) > BLOCK:
                yield from told()
    yield from told()


@dataclass(frozen=True)
class Model:
    """Language names, how many training rows each has, and smoothed probabilities (n-gram x language)."""

    names: list[str]
    rows: np.ndarray
    table: np.ndarray


def train(labelled: DataFrame, most: int = MOST_LANGUAGES) -> Model:
    """Learns from all rows with text and lang. The driver gets a row per language, and one for each of its n-grams (2**GRAM_BITS at most)."""
    arrow_rows(labelled.sparkSession)
    rows = labelled.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    seen = sorted((r["lang"], r["n"]) for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most + 1).collect())
    if len(seen) > most:
        raise ValueError(f"lang has more than {most} values")
    names = [x for x, _ in seen]
    table = np.full((1 << GRAM_BITS, len(names)), 0.5)
    if names:
        counts = map_arrow(rows, "language", _counted, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
        code = pc.index_in(counts["lang"], pa.array(names, counts["lang"].type)).to_numpy()
        table[counts["gram"].to_numpy(), code] += counts["n"].to_numpy()
    return Model(names, np.array([n for _, n in seen], np.int64), (table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def _fit(share: np.ndarray, p: np.ndarray, count: np.ndarray, doc: np.ndarray, head: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """EM on the proportions of many documents at once; also their log-likelihoods. Shares of 0 stay 0."""
    total = np.add.reduceat(count, head)
    for _ in range(rounds):
        weight = count / np.einsum("ij,ij->i", share[doc], p)
        share = share * np.add.reduceat(p * weight[:, None], head, axis=0) / total[:, None]
        share /= share.sum(axis=1, keepdims=True)
    like = np.add.reduceat(count * np.log(np.einsum("ij,ij->i", share[doc], p)), head)
    return share, like


def infer(off: np.ndarray, data: np.ndarray, table: np.ndarray, rounds: int = 8, allowed: np.ndarray | None = None) -> np.ndarray:
    """Proportions (text x language) after the choice of languages; zeros where a text has no n-gram. allowed: the languages that each text may have."""
    n, k = len(off) - 1, table.shape[1]
    out = np.zeros((n, k))
    doc, gram = grams(off, data)
    if not len(doc) or not k:
        return out
    cell, count = np.unique((doc << GRAM_BITS) | gram, return_counts=True)
    doc, p, count = cell >> GRAM_BITS, table[cell & ((1 << GRAM_BITS) - 1)], count.astype(np.float32) * np.float32(TEMPER)
    there, head, local = np.unique(doc, return_index=True, return_inverse=True)
    share = np.full((len(there), k), 1 / k, np.float32) if allowed is None else (allowed[there] / allowed[there].sum(axis=1, keepdims=True)).astype(np.float32)
    share, like = _fit(share, p, count, local, head, rounds)
    penalty = 0.5 * np.log(np.maximum(np.add.reduceat(count, head), 2))
    alive = np.arange(len(there))
    for _ in range(k - 1):
        alive = alive[(share[alive] > 0).sum(axis=1) > 1]
        if not len(alive):
            break
        less = share[alive].copy()
        weak = np.where(less > 0, less, 2).argmin(axis=1)
        less[np.arange(len(alive)), weak] = 0
        less /= less.sum(axis=1, keepdims=True)
        number = np.full(len(there), -1)
        number[alive] = np.arange(len(alive))
        mine = number[local]
        pick = np.flatnonzero(mine >= 0)
        now = mine[pick]
        less, fitted = _fit(less, p[pick], count[pick], now, np.flatnonzero(np.r_[True, now[1:] != now[:-1]]), max(2, rounds // 2))
        better = fitted + penalty[alive] >= like[alive]
        share[alive[better]], like[alive[better]] = less[better], fitted[better]
        alive = alive[better]
    out[there] = share
    return out


def infer_any(off: np.ndarray, data: np.ndarray, table: np.ndarray, block: int = BLOCK) -> np.ndarray:
    """`infer` for any number of languages: each block of them chooses, and what is chosen meets, for so many texts at once as name no more than a block together."""
    n, k = len(off) - 1, table.shape[1]
    if k <= block:
        return infer(off, data, table)
    chosen = np.hstack([infer(off, data, np.ascontiguousarray(table[:, a : a + block])) > 0 for a in range(0, k, block)])
    out, i = np.zeros((n, k)), 0
    while i < n:
        j, these = i + 1, chosen[i]
        while j < n and (these | chosen[j]).sum() <= block:
            these, j = these | chosen[j], j + 1
        if len(at := np.flatnonzero(these)):
            out[i:j, at] = infer(off[i : j + 1] - off[i], data[off[i] : off[j]], np.ascontiguousarray(table[:, at]), allowed=chosen[i:j][:, at])
        i = j
    return out


def _has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def detect(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """keep..., lang_pred, score, languages (the chosen set, largest first) of every row of docs."""
    spark = docs.sparkSession
    arrow_rows(spark)
    names, shared = model.names, spark.sparkContext.broadcast(model.table)
    prior = model.rows / max(1, int(model.rows.sum()))
    rows = docs.select(*keep, F.col("text").cast("string").alias("_text"))
    schema = type(rows.schema)(rows.schema.fields[:-1]).add("lang_pred", "string").add("score", "double").add("languages", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            off, data = utf8(batch["_text"])
            shares = [infer_any(off[i : j + 1] - off[i], data[off[i] : off[j]], shared.value) for i, j in slices(off)]
            share = np.concatenate(shares) if shares else np.zeros((0, len(names)))
            lang, score, chosen = [], [], []
            for row, text in zip(share, batch["_text"].to_pylist(), strict=True):
                if len(row) and row.max() <= 0:
                    row = prior
                if not len(row) or not _has_letter(text):
                    lang.append("und")
                    score.append(0.0)
                    chosen.append("")
                else:
                    best = int(row.argmax())
                    lang.append(names[best])
                    score.append(min(1.0, float(row[best])))
                    chosen.append(",".join(names[i] for i in np.argsort(-row, kind="stable") if row[i] > 0))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(chosen, pa.string())], schema.names)

    return map_arrow(rows, "language", run, schema)


def language_report(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, languages; learned from the rows that are not held out."""
    held = (F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) == 2).alias("held_out")
    return detect(docs, train(docs.where(~held)), F.col("doc_id").cast("long").alias("doc_id"), held)
