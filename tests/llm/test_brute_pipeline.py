"""The mix word by word, and the whole pipeline, against plain Python: every row, text and piece id."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import LOWER, ROWS, WORD, brute_pieces, docs, table, words  # noqa: F401  docs is a fixture

from movewise.llm import mixing, quality, sentencepiece_codec

P = pytest.importorskip("public_tokenizers")
corpus_pipeline = pytest.importorskip("corpus_pipeline")
MOST, SEED = 3, 17


def by_quotients(weights, seats, caps):
    """Seats one by one, to the highest quotient; ties to the first."""
    got = [0] * len(weights)
    for _ in range(seats):
        free = [k for k in range(len(weights)) if weights[k] > 0 and got[k] < caps[k]]
        if not free:
            break
        got[max(free, key=lambda k: (weights[k] / (2 * got[k] + 1), -k))] += 1
    return got


def filled(sizes, weights):
    """Targets: shares by weight, none above MOST times its size, the excess shared again."""
    target, free, left = [0.0] * len(sizes), set(range(len(sizes))), float(sum(sizes))
    while free:
        share = {k: left * weights[k] / sum(weights[x] for x in free) for k in free}
        over = [k for k in free if share[k] > MOST * sizes[k]]
        for k in over or free:
            target[k] = float(MOST * sizes[k]) if over else share[k]
        if not over:
            break
        left -= sum(target[k] for k in over)
        free -= set(over)
    return target


def brute_mix(spark, rows, block=64, stream=16_384):
    """rows: (doc_id, text, source). For each row, how often each of its words is taken."""
    sizes = [len(words(t)) for _, t, _ in rows]
    keyed = spark.createDataFrame([(k, i, n) for k, ((i, _, _), n) in enumerate(zip(rows, sizes, strict=True))], "k int, doc_id long, size long")
    h = {r["k"]: r["h"] for r in keyed.select("k", F.xxhash64(F.lit(SEED), "doc_id", "size").alias("h")).collect()}
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    held = {s: [k for k, r in enumerate(rows) if r[2] == s] for s in names}
    size = [sum(sizes[k] for k in held[s]) for s in names]
    target = filled(size, [(5.0, 2.0, 1.0)[k % 3] for k in range(len(names))])
    shards = [max(1, math.ceil(n / stream)) for n in size]
    seats = by_quotients(target, math.ceil(sum(size) / block), [math.ceil(n * MOST / block) + MOST * s for n, s in zip(size, shards, strict=True)])
    times = {}
    for name, whole, goal, n_shards, n_seats in zip(names, size, target, shards, seats, strict=True):
        dealt = {s: sorted((k for k in held[name] if h[k] % n_shards == s), key=lambda k: (h[k], rows[k][0], sizes[k])) for s in range(n_shards)}
        dealt = {s: ks for s, ks in dealt.items() if ks}
        length = {s: sum(sizes[k] for k in ks) for s, ks in dealt.items()}
        blocks = {s: max(1, round(n / block)) if n else 0 for s, n in length.items()}
        caps = [MOST * blocks[s] for s in dealt]
        quota = caps if goal >= MOST * whole else by_quotients([length[s] for s in dealt], round(n_seats * block * sum(blocks.values()) / whole), caps)
        for s, q in zip(dealt, quota, strict=True):
            if not length[s]:
                times |= {k: [] for k in dealt[s]}
                continue
            more = set(np.random.default_rng([SEED, zlib.crc32(("n" if name is None else f"s{name}").encode()), s]).permutation(blocks[s])[: q % blocks[s]].tolist())
            often = [q // blocks[s] + (b in more) for b in range(blocks[s]) for _ in range(length[s] * b // blocks[s], length[s] * (b + 1) // blocks[s])]
            at = 0
            for k in dealt[s]:
                times[k] = often[at : at + sizes[k]]
                at += sizes[k]
    return times, target


def rounds(text, times):
    """The texts that a document gives: round by round, stretches of taken words with the white space inside them."""
    spans = [m.span() for m in WORD.finditer(text or "")]
    for turn in range(1, max(times, default=0) + 1):
        if min(times) >= turn:
            yield text
            continue
        some = [k for k, n in enumerate(times) if n >= turn]
        first = [k for k in some if k - 1 not in some]
        last = [k for k in some if k + 1 not in some]
        yield "\n".join(text[spans[a][0] : spans[b][1]] for a, b in zip(first, last, strict=True))


@pytest.mark.parametrize(("block", "stream"), [(8, 500), (64, 16_384), (5, 60)])
def test_taken_words_are_those_of_plain_python(spark, docs, block, stream):  # noqa: F811
    rows = [(i, t, s) for i, t, _, s in ROWS]
    times, target = brute_mix(spark, rows, block, stream)
    got = mixing.mix_report(docs, block=block, stream=stream).collect()
    assert sorted((r["doc_id"], r["taken"]) for r in got) == sorted((rows[k][0], sum(n)) for k, n in times.items())
    assert sorted(r["target"] for r in got) == pytest.approx(sorted(target[i] for i in (sorted({s for *_, s in rows}, key=lambda s: (s is None, s or "")).index(s) for *_, s in rows)))
    want = sorted((rows[k][0], x) for k, n in times.items() for x in rounds(rows[k][1], n))
    assert sorted((r["doc_id"], r["text"]) for r in mixing.mix(docs, block=block, stream=stream).collect()) == want


def keeps(text):
    """The quality rules' verdict."""
    w, limits = words(text), quality.Limits()
    total = max(1, sum(map(len, w)))
    triples = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    inside = {j for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for j in range(k, k + 3)}
    bad = len(w) < quality.LEAST_WORDS or 100 * len(inside) > quality.MOST_REPEAT_PERCENT * len(w)
    for n in range(2, 11):
        at = collections.defaultdict(list)
        for k in range(len(w) - n + 1):
            at[tuple(w[k : k + n])].append(k)
        twice = {g: ks for g, ks in at.items() if len(ks) > 1}
        bad |= max((len(ks) * sum(map(len, g)) for g, ks in twice.items()), default=0) > limits.in_top.get(n, 9.0) * total
        bad |= sum(len(w[j]) for j in {a + d for ks in twice.values() for a in ks for d in range(n)}) > limits.in_repeated.get(n, 9.0) * total
    told = [x for x in (text or "").split("\n") if WORD.search(x)]
    again = [x for k, x in enumerate(told) if x in told[:k]]
    return not (bad or (len(again) > 1 and len(again) > limits.lines * len(told)) or sum(len(y) for x in again for y in words(x)) > limits.line_chars * total)


def without_common_lines(rows):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    held = collections.defaultdict(set)
    for i, t, _ in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= 40:
                held[key(x)].add(i)
    stays = lambda i, x: len(held.get(key(x), ())) < 5 or i == max(held[key(x)])
    return [(i, t if t is None else "\n".join(x for x in t.split("\n") if stays(i, x)), s) for i, t, s in rows]


def one_of_each_group(rows):
    sets = []
    for _, t, _ in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    return [r for k, r in enumerate(rows) if r[0] == min(x[0] for x, g in zip(rows, group, strict=True) if g == group[k])]


def pipeline_rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choice("abcdeghiklmnorstué漢K") for _ in range(rng.randint(1, 8))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    line, passage, rows = "A line of well over forty characters in very many documents", text(60), []
    for k in range(70):
        t = text(rng.randint(20, 400))
        if k % 4 == 0:
            t = f"{t}\n  {line.upper() if k % 8 else line}\t\n{text(12)}"
        if k % 9 == 0:
            t = f"{passage} {t} {passage}" if k % 2 else f"{t}\n{passage}"
        rows.append((k, t.replace(" ", "  ", 3), rng.choice(["a", "a", "a", "b", "Z", None])))
    for k, (_, t, _) in enumerate(rows[1:40:6]):
        w = t.split(" ")
        for edits in (0, 1, 4, 60):
            for _ in range(min(edits, len(w))):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            rows.append((100 + 10 * k + edits % 9, " ".join(w), rng.choice(["a", "b"])))
    return [*rows, (200, None, "a"), (201, "", "b"), (202, "spam eggs " * 80, "b"), (203, "\n".join([text(9)] * 9), None), (204, text(4000), "long"), (205, "x" * 3000 + " " + text(80), "Z")]


def test_pipeline_is_that_of_plain_python(spark, tmp_path):
    rows = pipeline_rows()
    table(spark, [(i, t, "en", s) for i, t, s in rows]).repartition(4).write.parquet(f"file://{tmp_path}/documents.parquet")
    kept = [r for r in rows if keeps(r[1])]
    lines = without_common_lines(kept)
    near = one_of_each_group(lines)
    assert len(rows) - 6 > len(kept) > len(near) + 4 and any(a != b for a, b in zip(kept, lines, strict=True))
    times, _ = brute_mix(spark, near)
    mixed = [(near[k][0], text) for k, n in times.items() for text in rounds(near[k][1], n)]
    assert len({t for _, t in mixed}) > len(near) / 2
    codec = sentencepiece_codec.Codec(P.path("piece_bpe_32k.model"))
    ids = {t: brute_pieces(codec, t) for _, t in mixed}
    want = sorted((i, len(ids[t]), zlib.crc32(np.array(ids[t], "<u4").tobytes()), hashlib.sha256(t.encode()).hexdigest()) for i, t in mixed)
    got = corpus_pipeline.run(spark, f"file://{tmp_path}")
    assert sorted(tuple(r) for r in got.select("doc_id", "n_ids", "ids_crc32", "decoded_sha256").collect()) == want
