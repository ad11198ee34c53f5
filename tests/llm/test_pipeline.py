"""The pipeline against its stages' brute-force rules on a small folder of documents."""

import collections
import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(9)
    vocabulary = ["".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line = "this very line is held by a good many documents of the set"
    rows = [(k, text(rng.randint(60, 200)) + (f"\n{line}\n" + text(10) if k % 3 == 0 else ""), "en", f"s{k % 4}") for k in range(30)]
    near = rows[1][1].split()
    rows += [(30 + k, " ".join(near[:-1] + [vocabulary[k]]), "en", "s1") for k in range(4)]
    rows += [(50, "too short", "en", "s0"), (51, None, "en", "s0"), (52, "spam spam " * 50, "en", "s2")]
    out = tmp_path_factory.mktemp("sf")
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"file://{out}/documents.parquet")
    return f"file://{out}", rows, line


def test_stages_and_run(spark, folder):
    sf, rows, line = folder
    docs, kept = spark.read.parquet(f"{sf}/documents.parquet"), {}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        kept[name] = docs.cache()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    quality, lines, near, mixed, encoded = kept.values()
    assert {r["doc_id"] for r in quality.collect()} == {i for i, *_ in rows if i < 50}
    holders = [i for i, t, *_ in rows if i < 50 and line in t]
    assert {r["doc_id"] for r in lines.collect() if line in r["text"]} == {max(holders)}
    assert lines.where(F.length("text") != F.col("n_chars")).isEmpty()
    assert {r["doc_id"] for r in near.collect()} == {i for i, *_ in rows if i < 30}
    per_doc = collections.Counter(r["doc_id"] for r in mixed.collect())
    assert set(per_doc) <= set(range(30)) and max(per_doc.values()) <= 3
    assert sum(len(re.findall(r"[^\x20\x09-\x0D]+", r["text"])) for r in mixed.collect()) == pytest.approx(sum(len(r["text"].split()) for r in near.collect()), rel=0.15)
    want = sorted((r["doc_id"], hashlib.sha256(r["text"].encode()).hexdigest()) for r in mixed.collect())
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in encoded.collect()) == want
    assert sorted((r["doc_id"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, sf).collect()) == want


ODD = "doc_id long, text string, lang string, source string, n_chars long, c string, comp int, stays boolean, copy int, k_gone array<int>, pieces map<string,int>, c_0 string, _id string, size int"


def odd_rows():
    rng = random.Random(2)
    text = lambda n: " ".join(f"w{rng.randint(0, 900)}" for _ in range(n))
    line = "one line of well over forty code points that all of these documents do hold"
    near = text(120)
    rows = [(k, f"{text(80)}\n{line}\n{text(20)}", "en", None if k % 2 else "s") for k in range(8)] + [(None, near, None, None), (None, near, None, None), (None, near + " more", None, "s"), (40, near, "en", "s"), (40, near, "en", "s"), (41, None, None, None), (41, "", None, None)]
    return [(i, t, lang, s, len(t or ""), "x", 1, False, 2, [1], {"a": 1}, "y", "z", 3) for i, t, lang, s in rows]


def test_stages_on_odd_tables(spark):
    """Null ids and sources, repeated rows, names that the operators use themselves, and no rows at all."""
    odd, none = spark.createDataFrame(odd_rows(), ODD), spark.createDataFrame([], ODD)
    for name, stage in corpus_pipeline.STAGES:
        for docs in (odd, none):
            out = stage(spark, docs, "")
            if name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
            rows = out.collect()
            assert bool(rows) == (docs is odd), name
            if docs is odd and name == "n-gram Jaccard join":
                assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows) == [(False, k) for k in [*range(8), 40, 41, 41]]
            if docs is odd and name != corpus_pipeline.STAGES[-1][0]:
                assert all((r["c"], r["comp"], r["k_gone"], r["pieces"], r["c_0"], r["_id"], r["size"]) == ("x", 1, [1], {"a": 1}, "y", "z", 3) for r in rows), name
            if docs is odd and name == "line dedup":
                assert sum("well over forty" in (r["text"] or "") for r in rows) == 1 and sum(r["text"] is None for r in rows) == 1
