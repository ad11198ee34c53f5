"""N-gram Jaccard join (operator 3): count-vector R-trees behind an exact prefix filter.

A document is the set of its distinct 5-word shingles (64-bit hashes); equal sets are one *class*.
Two classes link when their Jaccard similarity reaches the threshold, and the result is the connected
components of links.

1. Candidates. With hashes in an order that puts common ones last, two sets that link must share at
   least l of their first n - ceil(t n) + l shingles (l is 3 % of a set, of the smaller in a pair).
   Only those are shuffled. Groups of one class end here, and so do classes with fewer than l shingles
   in any group: passages that texts share do not get further unless they are a good part of a text.
2. Stars. In each group classes are verified against one leader only, which connects the copies of a
   text in linear work, however many there are. Groups that now lie in one component are done.
3. R-trees over the classes that a leader met in any group, twice: first only the closest pair of each two components that meet in a group is
   verified, which connects stragglers to large components without all their pairs; then every pair
   that is left between components. Shingles are hashed into 64
   groups and the counts indexed as points: an R-tree node holds the coordinate-wise maxima and the
   smallest set size of its points, so the sum of coordinate minima bounds every overlap below it.
   Nodes that cannot reach the threshold, or that hold only the query's own component, are skipped;
   leaders with a leaf or two are bounded pair by pair, many at once. Surviving pairs are verified on
   their sets. The classes of a large leader are split into blocks of neighbouring
   sizes, and only pairs of blocks whose sizes can link meet; no pair is lost or capped.

Scale: no step holds more than a block, a class and its leader, or one document in memory. Prefixes
carry a hash and a class, not sets; sets and vectors are computed and shuffled only for classes in a
candidate pair or in a group of several components, which a fixed-size bitmap of text keys decides before
the shuffle. Common shingles, leaders and components are summed up by aggregates with a map side, and met
again by joins of written tables, which AQE may split where one is hot; windows see only shingles whose
number the sketch bounds, and the blocks of a leader, range by range. Components never reach the driver.

Cases: null or empty texts, or texts without a word, have no shingle and link with nothing. Fewer
words than 5 make one shingle of the whole sequence. A null doc_id ranks after all others; rows that
repeat a doc_id are separate documents, which share a component if their texts link. Ties do not
occur in the report. ``near_dedup`` keeps the smallest doc_id, then the smallest hash of the text, then
of the other columns; of rows alike in all columns one stays. A very long text is one set of hashes,
some fifteen times its size while it is made. An empty table gives an empty one. Other columns are
carried along by ``near_dedup``, whatever their names, and ignored by the report.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_rows, discard, fixed_filter, frequency_levels, let_through, lower_ascii, map_arrow, mark, may_hold, mix, parts, rolled, sketch_cell, slices, staged, that_may_meet, utf8, word_hashes, words
from .components import components

LAST_ID = 2**63 - 1
GROUPS = 512
#: Bits of a shingle hash that name a group; more than one shingle to a group would only add candidates.
TOKEN = np.uint64((1 << 48) - 1)
#: Classes of a residual group that are joined in one piece.
BLOCK = 2048
LEAF, FANOUT = 16, 16
#: Classes that a task remembers, so as not to repeat their sets.
REMEMBERED = 1 << 17


def shingle_sets(off: np.ndarray, data: np.ndarray, size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text of a run."""
    start, end, first = words(off, data)
    h = word_hashes(lower_ascii(data), start, end)
    grams = rolled(h, size)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= size:
            out.append(np.unique(grams[a : b - size + 1]))
        elif b > a:
            out.append(mix(rolled(h[a:b], b - a) + np.uint64(b - a)))
        else:
            out.append(grams[:0])
    return out


def class_of(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit class number of each set."""
    with np.errstate(over="ignore"):
        return mix(np.array([int(mix(s + np.uint64(1)).sum(dtype=np.uint64)) ^ len(s) for s in sets], np.uint64)).view(np.int64)


def shared_least(n):
    """l: so many shingles of the prefixes must be shared."""
    return (3 * n + 99) // 100


def prefix_length(n: int, percent: int) -> int:
    return n - (percent * n + 99) // 100 + shared_least(n) if n else 0


def packed_vector(shingles: np.ndarray) -> bytes:
    """A count vector in the narrowest type that holds it."""
    v = count_vector(shingles)
    return v.astype(np.uint8 if v.max() < 256 else np.uint16 if v.max() < 65536 else np.uint32).tobytes()


def unpacked_vectors(blobs: list[bytes]) -> np.ndarray:
    kinds = {GROUPS: np.uint8, 2 * GROUPS: np.uint16, 4 * GROUPS: np.uint32}
    return np.stack([np.frombuffer(b, kinds[len(b)]).astype(np.int32) for b in blobs]) if blobs else np.zeros((0, GROUPS), np.int32)


def count_vector(shingles: np.ndarray) -> np.ndarray:
    return np.bincount((shingles >> np.uint64(20)).astype(np.int64) & (GROUPS - 1), minlength=GROUPS).astype(np.int32)


def linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Exact test of two sorted sets, after the bound by their counts."""
    na, nb = len(a), len(b)
    if 100 * min(na, nb) < percent * max(na, nb):
        return False
    if (100 + percent) * int(np.minimum(count_vector(a), count_vector(b)).sum()) < percent * (na + nb):
        return False
    both = np.concatenate([a, b])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= percent * (na + nb - common)


class CountRTree:
    """Bulk-loaded R-tree over count vectors; boxes keep upper corners, size ranges, and the component if there is one only."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray) -> None:
        heavy = points.argmax(axis=1) if len(points) else np.zeros(0, np.int64)
        self.order = np.lexsort((heavy, sizes, comps))
        p, s, c = points[self.order], sizes[self.order], comps[self.order]
        self.points, self.sizes, self.comps = p, s, c
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]] = []
        high, low_n, high_n, low_c, high_c, width = p, s, s, c, c, LEAF
        while len(high) > 1 or not self.levels:
            cut = np.arange(0, len(high), width)
            high, low_n, high_n = np.maximum.reduceat(high, cut), np.minimum.reduceat(low_n, cut), np.maximum.reduceat(high_n, cut)
            low_c, high_c = np.minimum.reduceat(low_c, cut), np.maximum.reduceat(high_c, cut)
            self.levels.append((high, low_n, high_n, low_c, high_c, width))
            width = FANOUT
            if len(high) == 1:
                break

    def _may(self, q, n, comp, high, low_n, high_n, low_c, high_c, percent) -> np.ndarray:
        least = np.maximum(low_n, -(-percent * n // 100))  # a partner has at least so many
        ok = (100 * n >= percent * low_n) & (100 * high_n >= percent * n) & ~((low_c == comp) & (high_c == comp))
        ok[ok] &= (100 + percent) * np.minimum(q, high[ok]).sum(axis=1) >= percent * (n + least[ok])
        return ok

    def search(self, q: np.ndarray, n: int, comp: int, percent: int) -> np.ndarray:
        """Positions (in the caller's order) of points of other components that the bound does not exclude."""
        at = np.arange(len(self.levels[-1][0]))
        for k in range(len(self.levels) - 1, -1, -1):
            high, low_n, high_n, low_c, high_c, width = self.levels[k]
            at = at[self._may(q, n, comp, high[at], low_n[at], high_n[at], low_c[at], high_c[at], percent)]
            below = len(self.points) if k == 0 else len(self.levels[k - 1][0])
            at = (at[:, None] * width + np.arange(width)).ravel()
            at = at[at < below]
        ok = self._may(q, n, comp, self.points[at], self.sizes[at], self.sizes[at], self.comps[at], self.comps[at], percent)
        return self.order[at[ok]]


def _sets(batch: pa.RecordBatch, size: int) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    off, data = utf8(batch["text"])
    for i, j in slices(off):
        yield i, j, shingle_sets(off[i : j + 1] - off[i], data[off[i] : off[j]], size)


def _digests(size: int, percent: int, levels):
    """A row per document, with its prefix if the class is new to the task: shingles that the sketch finds common apart from the others."""

    def lists(parts: list[np.ndarray]) -> pa.ListArray:
        ends = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts).view(np.int64) if parts else np.zeros(0, np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for i, j, sets in _sets(batch, size):
                classes = class_of(sets)
                prefixes, common = [], []
                for c, s in zip(classes.tolist(), sets, strict=True):
                    if c in seen or not len(s):
                        prefixes.append(s[:0])
                        common.append(s[:0])
                        continue
                    if len(seen) < REMEMBERED:
                        seen.add(c)
                    level = levels.value[sketch_cell(s)]
                    order = np.argsort(level, kind="stable")[: prefix_length(len(s), percent)]
                    rare = int(np.searchsorted(level[order], 1))
                    prefixes.append(s[order[:rare]] & TOKEN)
                    common.append(s[order[rare:]] & TOKEN)
                yield pa.RecordBatch.from_arrays([batch["_id"].slice(i, j - i), batch["_tk"].slice(i, j - i), pa.array(classes), pa.array(np.array([len(s) for s in sets], np.int32)), lists(prefixes), lists(common)], ["_id", "_tk", "c", "n", "prefix", "common"])

    return run


def _wanted(size: int, shared, what: str):
    """Sets (body) or count vectors of the texts that the bitmap lets through, once per task."""
    packed = packed_vector if what == "vector" else np.ndarray.tobytes

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            batch = batch.filter(pa.array(may_hold(shared.value, batch["_tk"].to_numpy(zero_copy_only=False))))
            for _, _, sets in _sets(batch, size):
                c_out, body = [], []
                for c, s in zip(class_of(sets).tolist(), sets, strict=True):
                    if len(s) and c not in seen:
                        if len(seen) < REMEMBERED:
                            seen.add(c)
                        c_out.append(c)
                        body.append(packed(s))
                yield pa.RecordBatch.from_arrays([pa.array(c_out, pa.int64()), pa.array(body, pa.binary())], ["c", what])

    return run


def _verified(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch["a_body"].to_pylist(), batch["b_body"].to_pylist()
            ok = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(a, b, strict=True)]
            yield pa.RecordBatch.from_arrays([batch["u"], batch["v"]], ["u", "v"]).filter(pa.array(ok, pa.bool_()))

    return run


def _near_pairs(group: np.ndarray, n: np.ndarray, comp: np.ndarray, vectors: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bound for all pairs inside many small groups at once (rows of a group are neighbours): positions of surviving pairs, and the bound."""
    found = [(np.zeros(0, np.int64),) * 3]
    for d in range(1, len(group)):
        a = np.flatnonzero(group[:-d] == group[d:])
        if not len(a):
            break
        b = a + d
        ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        bound = np.concatenate([np.zeros(0, np.int64)] + [np.minimum(vectors[a[k : k + 2048]], vectors[b[k : k + 2048]]).sum(axis=1) for k in range(0, len(a), 2048)])
        ok = (100 + percent) * bound >= percent * (n[a] + n[b])
        found.append((a[ok], b[ok], bound[ok]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _closest(group: np.ndarray, comp_a: np.ndarray, comp_b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """Positions of the pair with the least distance for each two components of a group."""
    low, high = np.minimum(comp_a, comp_b), np.maximum(comp_a, comp_b)
    order = np.lexsort((apart, high, low, group))
    g, x, y = group[order], low[order], high[order]
    return order[np.r_[True, (g[1:] != g[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]] if len(order) else order


def _rtree_pairs(percent: int, closest: bool):
    """Rows of a (lead, i, j) key arrive together: side i is indexed, side j searches (i = j: each point the others)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, pile, small, groups = None, [], [], 0

        def made(group, a, b, bound) -> pa.RecordBatch:
            """a, b: class, size, component of both sides of each pair."""
            if closest:
                at = _closest(group, a[2], b[2], a[1] + b[1] - 2 * bound)
                a, b, bound = a[:, at], b[:, at], bound[at]
            swap = a[0] < b[0]
            u, v, cu, cv = (np.where(swap, y, x) for x, y in ((a[0], b[0]), (b[0], a[0]), (a[2], b[2]), (b[2], a[2])))
            return pa.RecordBatch.from_arrays([*map(pa.array, (u, v, cu, cv)), pa.array(a[1] + b[1] - 2 * bound)], ["u", "v", "cu", "cv", "apart"])

        def flush() -> pa.RecordBatch:
            row = np.array([r[:4] for r in small], np.int64).T
            a, b, bound = _near_pairs(row[0], row[2], row[3], unpacked_vectors([r[4] for r in small]), percent)
            return made(row[0][a], row[1:, a], row[1:, b], bound)

        def searched() -> pa.RecordBatch:
            i, j = now[1], now[2]
            own = [r for r in pile if r[0] == i]
            ask = own if i == j else [r for r in pile if r[0] == j]
            x, y, bounds = [], [], []
            points, queries = unpacked_vectors([r[4] for r in own]), unpacked_vectors([r[4] for r in ask])
            left, right = (np.array([r[1:4] for r in side], np.int64).T for side in (own, ask))
            tree = CountRTree(points, left[1], left[2])
            for at, q in enumerate(queries):
                hits = tree.search(q, int(right[1][at]), int(right[2][at]), percent)
                hits = hits[hits < at] if i == j else hits
                bound = np.minimum(points[hits], q).sum(axis=1)
                if closest and len(hits):
                    best = _closest(np.zeros(len(hits)), left[2][hits], np.full(len(hits), right[2][at]), left[1][hits] - 2 * bound)
                    hits, bound = hits[best], bound[best]
                x.append(hits)
                y.append(np.full(len(hits), at))
                bounds.append(bound)
            x, y, bound = (np.concatenate(v).astype(np.int64) for v in (x, y, bounds))
            return made(np.zeros(len(x)), left[:, x], right[:, y], bound)

        def done() -> Iterator[pa.RecordBatch]:
            nonlocal groups
            if now[1] == now[2] and len(pile) <= 2 * LEAF:
                if len({r[3] for r in pile}) > 1:
                    small.extend([groups, *r[1:]] for r in pile)
                    groups += 1
                if len(small) > 4096:
                    yield flush()
                    small.clear()
            elif {r[0] for r in pile} >= {now[1], now[2]}:
                yield searched()

        for batch in batches:
            cols = [batch[c].to_pylist() for c in ("lead", "i", "j", "block", "c", "n", "comp", "vector")]
            for t, i, j, *row in zip(*cols, strict=True):
                if now is not None and (t, i, j) != now:
                    yield from done()
                    pile = []
                now = (t, i, j)
                pile.append(row)
        if pile:
            yield from done()
        if small:
            yield flush()

    return run


class JaccardJoin:
    """The join over one table; digest, links and labels are its parts."""

    def __init__(self, docs: DataFrame, percent: int = 80, size: int = 5) -> None:
        self.spark, self.percent, self.size, self.since = docs.sparkSession, percent, size, mark()
        arrow_rows(self.spark)
        text = F.coalesce(F.col("text"), F.lit(""))
        self.rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text).alias("_tk"), text.alias("text"))
        levels = self.spark.sparkContext.broadcast(frequency_levels(self.rows, lambda batch: (np.concatenate(sets) for _, _, sets in _sets(batch, size) if sets))[0])
        self.digest = staged(map_arrow(self.rows, "jaccard", _digests(size, percent, levels), "_id long, _tk long, c long, n int, prefix array<bigint>, common array<bigint>"), "shingles")

    def _verify(self, pairs: DataFrame) -> tuple[DataFrame | None, int]:
        """The links among candidate pairs (u > v; None where there is no pair), and how many there are. Each class is read from one text."""
        pairs = staged(pairs.select("u", "v"), "pairs")
        if not (several := pairs.count()):
            return None, 0
        classes = pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "c")
        bodies = self._of_classes(classes, "body")
        one = pairs.join(bodies.select(F.col("c").alias("u"), F.col("body").alias("a_body")), "u")
        two = one.join(bodies.select(F.col("c").alias("v"), F.col("body").alias("b_body")), "v")
        links = staged(map_arrow(two.select("u", "v", "a_body", "b_body"), "jaccard", _verified(self.percent), "u long, v long"), "links", several, 5_000)
        return links, links.count()

    def _of_classes(self, classes: DataFrame, what: str) -> DataFrame:
        """(c, body or vector) of some classes, each from one text; a bitmap decides which texts are looked at again."""
        texts = self.digest.groupBy("c").agg(F.min("_tk").alias("_tk")).join(classes, "c", "left_semi")
        shared = self.spark.sparkContext.broadcast(fixed_filter(texts, "_tk"))
        return map_arrow(self.rows, "jaccard", _wanted(self.size, shared, what), f"c long, {what} binary").dropDuplicates(["c"])

    def _enough(self, rows: DataFrame) -> DataFrame:
        """rows (token, c, n, ...) without classes that have fewer rows than the least l of any class that could link with them."""
        counted = rows.groupBy("c", "n").agg(F.count("*").alias("rows"))
        smaller = F.ceil(F.lit(self.percent) * F.col("n") / 100)
        live = staged(counted.where(F.col("rows") >= F.ceil(F.lit(3) * smaller / 100)).select("c"), "live")
        return that_may_meet(rows, live, "c")

    def shared_prefixes(self) -> DataFrame:
        """(token, c, n, lead, lead_n): classes of each prefix shingle that several classes have, and one of them as leader."""

        lead, lead_n, high = F.min("c"), F.min_by("n", "c"), F.max("c")

        def led(rows: DataFrame) -> DataFrame:
            """Common shingles by an aggregate and a join, which a hot one does not hold up; all others, whose rows the sketch bounds, in one shuffle."""
            by = Window.partitionBy("token")
            cold = rows.where(~F.col("hot")).withColumns({"lead": lead.over(by), "lead_n": lead_n.over(by), "high": high.over(by)}).where(F.col("lead") != F.col("high")).drop("high")
            hot = rows.where("hot").groupBy("token").agg(lead.alias("lead"), lead_n.alias("lead_n"), high.alias("high")).where(F.col("lead") != F.col("high")).drop("high")
            return cold.unionByName(rows.where("hot").join(staged(hot, "hot"), "token").select(*cold.columns))

        prefix = lambda column, hot: self.digest.where(F.size(column) > 0).select(F.explode(column).alias("token"), "c", "n", F.lit(hot).alias("hot"))
        rows = prefix("prefix", False).unionByName(prefix("common", True))
        some = self._enough(staged(led(rows).select("token", "c", "n", "hot"), "prefixes"))
        return led(some).drop("hot")

    def star_pairs(self, groups: DataFrame) -> DataFrame:
        """Classes with their leaders, where half the shingles that a link needs are shared under this leader; others wait for the R-trees."""
        fit = (F.lit(100) * F.least("n", "lead_n")) >= (F.lit(self.percent) * F.greatest("n", "lead_n"))
        pairs = groups.where((F.col("c") != F.col("lead")) & fit).groupBy(F.col("c").alias("u"), F.col("lead").alias("v")).agg(F.count("*").alias("shared"), F.min(F.least("n", "lead_n")).alias("n"))
        return pairs.where(200 * F.col("shared") >= 3 * F.col("n"))

    def _blocks(self, mixed: DataFrame) -> DataFrame:
        """A block number for each class of a leader: 0 for up to BLOCK classes, else BLOCK neighbours by size, numbered within ranges of (leader, size)."""
        large = mixed.where(F.col("m") > BLOCK).drop("m")
        small = mixed.where(F.col("m") <= BLOCK).drop("m").withColumn("block", F.lit(0).cast("long"))
        if large.isEmpty():
            return mixed.drop("m").withColumn("block", F.lit(0).cast("long"))
        dealt = staged(large.repartitionByRange(parts(self.spark), "lead", "n", "c").withColumn("range", F.spark_partition_id().cast("long")), "ranges")
        place = F.row_number().over(Window.partitionBy("lead", "range").orderBy("n", "c")) - 1
        return small.unionByName(dealt.withColumn("block", F.shiftleft("range", 32) + F.floor(place / BLOCK)).drop("range"))

    def residual_pairs(self, members: DataFrame, known: DataFrame, closest: bool) -> DataFrame:
        """Candidate pairs across components, from R-trees over the count vectors of each leader's classes: one for each two components, or all."""
        label = known.withColumnsRenamed({"u": "c", "v": "comp"})
        rows = staged(members.join(label, "c", "left").withColumn("comp", F.coalesce("comp", "c")), "labels")
        several = rows.groupBy("lead").agg(F.min("comp").alias("a"), F.max("comp").alias("b"), F.count("*").alias("m")).where(F.col("a") != F.col("b")).select("lead", "m")
        mixed = rows.join(staged(several, "leads"), "lead").select("lead", "c", "n", "comp", "m")
        mixed = self._blocks(staged(mixed, "mixed"))
        blocks = mixed.groupBy("lead", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")).groupBy("lead").agg(F.array_sort(F.collect_list(F.struct("block", "low", "high"))).alias("all"))
        large = blocks.where(F.size("all") > 1)
        x = large.select("lead", F.explode("all").alias("x"), "all").select("lead", "x", F.explode(F.filter("all", lambda y: (y["block"] >= F.col("x.block")) & (F.lit(100) * F.col("x.high") >= F.lit(self.percent) * y["low"]))).alias("y"))
        sides = x.select("lead", F.col("x.block").alias("i"), F.col("y.block").alias("j")).select("lead", "i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
        vectors = self._of_classes(mixed.select("c").distinct(), "vector")
        keyed = mixed.join(sides, ["lead", "block"], "left").join(vectors, "c").select("lead", F.coalesce("i", "block").alias("i"), F.coalesce("j", "block").alias("j"), "block", "c", "n", "comp", "vector")
        found = map_arrow(keyed.repartition("lead", "i", "j").sortWithinPartitions("lead", "i", "j"), "jaccard", _rtree_pairs(self.percent, closest), "u long, v long, cu long, cv long, apart long")
        if not closest:
            return found.select("u", "v").distinct()
        best = found.groupBy(F.least("cu", "cv").alias("low"), F.greatest("cu", "cv").alias("high")).agg(F.min(F.struct("apart", "u", "v")).alias("p"))
        return best.select("p.u", "p.v")

    def components(self) -> DataFrame:
        """(c, comp) of the classes that have a link: comp is the smallest class number of the component."""
        since = mark()
        groups = staged(self.shared_prefixes(), "groups")
        links, several = self._verify(self.star_pairs(groups))
        known = components(links, several) if several else self.spark.createDataFrame([], "u long, v long")
        members = staged(groups.groupBy("lead", "c").agg(F.min("n").alias("n")), "members")
        for closest in (True, False):
            links, several = self._verify(self.residual_pairs(members, known, closest))
            if links is None:
                break
            if several:
                known = components(known.unionByName(links), known.count() + several)
        discard(since, known)
        return known.withColumnsRenamed({"u": "c", "v": "comp"})

    def labelled(self) -> DataFrame:
        """Every document: _id, _tk, n, comp (null where it has no shingle). Deletes the join's other tables: call it once."""
        out = self.digest.select("_id", "_tk", "c", "n").join(self.components(), "c", "left")
        out = staged(out.select("_id", "_tk", "n", F.when(F.col("n") > 0, F.coalesce("comp", "c")).alias("comp")), "labelled")
        discard(self.since, out)
        return out

    def report(self) -> DataFrame:
        """One row per document: doc_id, n_shingles, component_id."""
        rows = self.labelled()
        least = rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min("_id").alias("least"), F.count("*").alias("docs")).where("docs > 1").drop("docs")
        out = rows.join(staged(least, "least"), "comp", "left").select("_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("least", "_id").alias("k"))
        null = lambda c: F.when(F.col(c) != F.lit(LAST_ID), F.col(c))
        return out.select(null("_id").alias("doc_id"), "n_shingles", null("k").alias("component_id"))


def near_dedup(docs: DataFrame, percent: int = 80, size: int = 5) -> DataFrame:
    """docs with one document of each component; documents without a shingle all stay.

    Only texts of components with several documents are shuffled (a fixed-size bitmap of text keys decides).
    """
    spark = docs.sparkSession
    rows = JaccardJoin(docs, percent, size).labelled()
    best = rows.where(F.col("comp").isNotNull()).groupBy("comp").agg(F.min(F.struct("_id", "_tk")).alias("best"), F.count("*").alias("docs")).where("docs > 1").select("comp", "best")
    stays = (F.col("_id") == F.col("best._id")) & (F.col("_tk") == F.col("best._tk"))
    marks = staged(rows.join(staged(best, "best"), "comp").groupBy("_id", "_tk").agg(F.max(stays).alias("stays")), "marks")
    shared = spark.sparkContext.broadcast(fixed_filter(marks, "_tk"))
    names = {f"c_{i}": c for i, c in enumerate(docs.columns)}
    text = F.coalesce(F.col("text"), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST_ID)).alias("_id"), F.xxhash64(text).alias("_tk"), *[F.col(c).alias(a) for a, c in names.items()])
    alone = map_arrow(keyed, "jaccard", let_through(shared, "_tk", False), keyed.schema)
    met = map_arrow(keyed, "jaccard", let_through(shared, "_tk"), keyed.schema).join(marks, ["_id", "_tk"], "left")
    other = F.xxhash64(*[F.col(a) for a, f in zip(names, docs.schema.fields, strict=True) if f.dataType.typeName() not in ("map", "variant")])
    first = met.where("stays").withColumn("copy", F.row_number().over(Window.partitionBy("_id", "_tk").orderBy(other))).where("copy = 1")
    every = alone.unionByName(met.where("stays IS NULL").select(*keyed.columns)).unionByName(first.select(*keyed.columns))
    return every.select(*[F.col(a).alias(c) for a, c in names.items()])


__all__ = ["CountRTree", "JaccardJoin", "near_dedup"]
