"""Texts longer than what is hashed at once (512 kB) and than a run of texts (4 MB), and words longer than that, against brute force."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F
from test_llm_operators import LOWER, table, words

from movewise.llm import exact_dedup, jaccard_join, line_dedup, quality, substring_dedup
from movewise.llm.common import PIECE


def long_rows():
    rng = random.Random(31)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(3, 9))) for _ in range(6000)]
    long = [rng.choice(vocabulary) for _ in range(800_000)]
    per_piece = PIECE * len(long) // len(" ".join(long))
    rows = [(10, " ".join(long))]
    middle = [rng.choice(vocabulary) for _ in range(150_000)]
    for at in (per_piece - 40, 3 * per_piece - 60, len(long) - 90):  # across the ends of pieces, and at the end of the text
        middle[at // 8 : at // 8 + 90] = long[at : at + 90]
    line = "this line of more than forty code points is at the very end of five texts"
    rows.append((11, " ".join(middle)))
    rows += [(20 + k, " ".join([rng.choice(vocabulary) for _ in range(30)] + long[at : at + 70]) + f"\n{line}") for k, at in enumerate((0, per_piece - 35, 2 * per_piece - 1, len(long) - 70))]
    rows.append((5, " ".join(long[:-1]) + f" z\n{line}"))  # one word off
    rows.append((30, "y" * (PIECE + 100_000) + " " + " ".join(middle[:80])))
    return rows


ROWS = long_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, [(i, t, "en", "a") for i, t in ROWS]).repartition(3).cache()


def test_substrings_of_long_texts(docs):
    texts = {i: words(t) for i, t in ROWS}
    owner = {}
    for i in sorted(texts):
        for k in range(len(texts[i]) - 49):
            owner.setdefault(hash(tuple(texts[i][k : k + 50])), i)
    want = []
    for i, w in texts.items():
        gone, until = [False] * len(w), 0
        for k in range(len(w) - 49):
            if owner[hash(tuple(w[k : k + 50]))] < i:
                for j in range(max(k, until), k + 50):
                    gone[j] = True
                until = k + 50
        want.append((i, len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone, strict=True) if not g).encode()).hexdigest()))
    assert sorted(tuple(r) for r in substring_dedup.substring_report(docs).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == sorted(want)
    assert sum(n > 0 for *_, n, _ in want) == 7


def test_counts_and_groups_of_long_texts(docs):
    got = {r["doc_id"]: r for r in quality.quality_report(docs).collect()}
    shingles = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_join.JaccardJoin(docs).report().collect()}
    for i, t in ROWS:
        w = words(t)
        triples = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        inside = {j for k in range(len(w) - 2) if triples[w[k], w[k + 1], w[k + 2]] > 1 for j in (k, k + 1, k + 2)}
        assert (got[i]["n_words"], got[i]["word_chars"], got[i]["n_repeat_words"], got[i]["n_dup_lines"]) == (len(w), sum(map(len, w)), len(inside), 0), i
        low = words(t.translate(LOWER))
        assert shingles[i] == (len(set(zip(low, low[1:], low[2:], low[3:], low[4:], strict=False))), 5 if i == 10 else i)


def test_lines_and_copies_of_long_texts(docs):
    lines = {r["doc_id"]: r["n_dropped"] for r in line_dedup.line_report(docs).collect()}
    assert lines == {i: int(i in (5, 20, 21, 22)) for i, _ in ROWS}
    spread = docs.withColumn("text", F.when(F.col("doc_id") == 10, F.replace("text", F.lit(" "), F.lit("  "))).otherwise(F.col("text"))).withColumn("doc_id", F.col("doc_id") + 100)
    copies = exact_dedup.exact_groups(docs.unionByName(spread)).collect()
    assert {r["doc_id"]: (r["keep_id"], r["group_size"]) for r in copies} == {j: (110 if i == 10 else i, 2) for i, _ in ROWS for j in (i, i + 100)}
    assert all(r["text_sha256"] == hashlib.sha256("".join(words(dict(ROWS)[r["doc_id"] % 100])).encode()).hexdigest() for r in copies)
