"""Near-duplicate groups by bottom-k sketches of one hash function.

Each document's shingles are hashed once; its sketch is the least hashes of its set. Documents with equal shingle sets are one class from the start.
 1. Inverted lists of retained values. A set of n keeps its n - ceil(t n) + m(n) least hashes (all, if it has no more), t being the threshold: linked sets
    then share at least m of the smaller size of them (or all that they share), whatever the hashes. So a class only needs to stand in the lists of all but so many
    (less one) of its retained values, the most frequent left out, and a class of which fewer values occur elsewhere stands in none. No link is lost.
 2. Shingles that no other such class has are counted for each class, which bounds intersections exactly.
    Long lists are not paired off. The most central member of each list (whose retained values stand in the longest lists) is compared with the others
    (a star); links merge components, and a list whose members are all of one component is done. The lists still split are gathered by the component of
    their head; members are described by how they differ from what most of them share, and two of different components are compared only if enough of
    their differences can agree (beyond_star). So a group of n copies that resemble their centre costs about n comparisons.
 3. The union sketch drops pairs: up to the lesser of the two largest retained values both sets are known, and what is shared beyond can't exceed the rest
    of the smaller one. A bound is taken, not the mean, so that no link is lost.
 4. Full sets confirm each link, exactly, in integers.
 5. Components by least-label propagation with pointer jumping, on tables.

Words are [^\\x20\\x09-\\x0D]+ after lower-casing A-Z. Fewer words than a shingle has: the whole sequence is the one shingle. No words or null text: an empty
set, linked with nothing, and kept. Null doc_id: linked like others; component_id is the least doc_id of the component, null if it has none, and such a
document is kept only then. Repeated rows: of one class, the same result for each. Very long texts: whole, with a sketch in proportion. Ties: none matter,
as components don't depend on order. Extra columns, whatever their names: not read; deduplicated keeps them. Empty table: no rows.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, free_name, map_columns, materialise, release, small_batches, words_of

#: Linked sets share so many retained values at least (if they have as many), or this share of the smaller set: more of them make longer sketches, but
#: fewer classes in the lists.
SHARED, SHARE_OF = 16, 0.15
_WORDS_KEPT = 200_000
_U = np.uint64


class _Hashes(dict):
    """64-bit hashes of words, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _WORDS_KEPT:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_HASHES = _Hashes()


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct hashes of the text's shingles, from the one hash function."""
    words = words_of(text, lower=True)
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(_HASHES.__getitem__, words), _U, len(words))
    with np.errstate(over="ignore"):
        n = min(width, len(h))
        x = np.full(len(h) - n + 1, n, _U)
        for k in range(n):
            x = _mixed((x + h[k : k + len(x)]) * _U(0x9E3779B97F4A7C15))
    return np.unique(x.view(np.int64))


def shared_values(n: int) -> int:
    """Retained values that a set of n shares with a linked set that isn't smaller."""
    return max(SHARED, math.ceil(SHARE_OF * n))


def kept_values(n: int, num: int, den: int) -> int:
    """Length of the sketch of a set of n."""
    return min(n, n - -(-n * num // den) + shared_values(n))


def union_bound(a: np.ndarray, b: np.ndarray, n: int, m: int) -> int:
    """Most values that two sets of n and m can share, by their sketches (all values up to the last one kept; a sketch as long as its set is the set)."""
    last_a = np.iinfo(np.int64).max if len(a) == n else a[-1]
    last_b = np.iinfo(np.int64).max if len(b) == m else b[-1]
    a, b = a[a <= min(last_a, last_b)], b[b <= min(last_a, last_b)]
    return len(np.intersect1d(a, b, assume_unique=True)) + min(n - len(a), m - len(b))


def sketches(docs: DataFrame, width: int, num: int, den: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, cid (class of equal sets), sketch."""

    def make():
        def step(c):
            sets = [shingle_set(t, width) for t in c["text"]]
            cid = [int.from_bytes(xxhash.xxh3_64_digest(s.tobytes()), "big", signed=True) for s in sets]
            return {"doc_id": c["doc_id"], "text_hash": c["text_hash"], "n_shingles": [len(s) for s in sets], "cid": cid, "sketch": [s[: kept_values(len(s), num, den)] for s in sets]}

        return step

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    return map_columns(slim, "doc_id long, text_hash long, n_shingles long, cid long, sketch array<long>", make)


def _least_id() -> Column:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))


def estimated(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs (a, b) that the union sketch doesn't rule out."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))

    def make():
        def step(c):
            out = {"a": [], "b": []}
            for a, b, x, y, n, m in zip(c["a"], c["b"], c["sa"], c["sb"], c["na"], c["nb"], strict=True):
                if (num + den) * union_bound(np.array(x, np.int64), np.array(y, np.int64), n, m) >= num * (n + m):
                    out["a"].append(a)
                    out["b"].append(b)
            return out

        return step

    return map_columns(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "sa", "sb", "na", "nb"), "a long, b long", make)


def overlaps(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """a, b, shared, union: sizes over the full sets of pairs (a, b)."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}"))

    def make():
        recent: dict[int, np.ndarray] = {}

        def of(cid, text):
            if cid not in recent:
                if len(recent) > 512:
                    recent.clear()
                recent[cid] = shingle_set(text, width)
            return recent[cid]

        def step(c):
            shared, union = [], []
            for a, b, x, y in zip(c["a"], c["b"], c["ta"], c["tb"], strict=True):
                p, q = of(a, x), of(b, y)
                shared.append(len(np.intersect1d(p, q, assume_unique=True)))
                union.append(len(p) + len(q) - shared[-1])
            return {"a": c["a"], "b": c["b"], "shared": shared, "union": union}

        return step

    return map_columns(pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb"), "a long, b long, shared long, union long", make)


def full_sets(texts: DataFrame, width: int) -> DataFrame:
    def make():
        return lambda c: {"cid": c["cid"], "shingles": [shingle_set(t, width) for t in c["text"]]}

    return map_columns(texts, "cid long, shingles array<long>", make)


def components(links: DataFrame) -> DataFrame:
    """node, comp (the least node reachable) for the nodes of links (a, b)."""
    edges = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "dedup-edges")
    labels = materialise(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("comp")).withColumnRenamed("a", "node"), "dedup-labels")
    while True:
        seen = edges.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("comp").alias("seen")).withColumnRenamed("a", "node")
        lower = labels.join(seen, "node").select("node", F.col("comp").alias("was"), F.least("comp", "seen").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        moved = lower.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("far", "comp")).alias("comp"))
        moved = materialise(moved, "dedup-labels")
        labels = moved.select("node", "comp")
        if moved.where("was <> comp").isEmpty():
            return labels


#: Turns a shingle into a mark of its absence.
_ABSENT = np.int64(0x5DEECE66D1CE4E5B)


def differences(members: DataFrame, texts: DataFrame, width: int, shift: DataFrame | None = None) -> DataFrame:
    """members with `marks`: how a member's set differs from its head's, or from its head's as shift (head, marks) alters it. A shingle that only the
    member has is a mark, and one that it lacks is a mark too, turned by _ABSENT."""
    side = lambda x: texts.select(F.col("cid").alias(x), F.col("text").alias(f"t{x}"))
    both = members.join(side("cid"), "cid").join(side("head"), "head")
    both = both.join(shift.select("head", F.col("marks").alias("shift")), "head", "left") if shift else both.withColumn("shift", F.lit(None).cast("array<long>"))

    def make():
        recent: dict[int, np.ndarray] = {}

        def of(cid, text):
            if cid not in recent:
                if len(recent) > 64:
                    recent.clear()
                recent[cid] = shingle_set(text, width)
            return recent[cid]

        def marks(text, head, head_text, shift):
            own, other = shingle_set(text, width), of(head, head_text)
            found = np.concatenate([np.setdiff1d(own, other, assume_unique=True), np.setdiff1d(other, own, assume_unique=True) ^ _ABSENT])
            if not shift:
                return found
            shift = np.array(shift, np.int64)
            # a mark of the shift that the member has is none from the shifted set; one that it lacks is the opposite mark
            return np.concatenate([np.setdiff1d(found, shift), np.setdiff1d(shift, found) ^ _ABSENT])

        def step(c):
            found = [marks(*x) for x in zip(c["tcid"], c["head"], c["thead"], c["shift"], strict=True)]
            return {**{x: c[x] for x in ("head", "cid", "n", "comp")}, "far": [len(x) for x in found], "marks": found}

        return step

    return map_columns(both.select("head", "cid", "n", "comp", "tcid", "thead", "shift"), "head long, cid long, n long, comp long, far long, marks array<long>", make)


def consensus(members: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """head, marks: what tells most members of a head from it."""
    marks = differences(members, texts, width).select("head", F.explode("marks").alias("r")).groupBy("head", "r").agg(F.count(F.lit(1)).alias("df"))
    size = members.groupBy("head").agg(F.count(F.lit(1)).alias("members"))
    return marks.where("df > 1").join(size, "head").where("2 * df > members").groupBy("head").agg(F.collect_list("r").alias("marks"))


def beyond_star(members: DataFrame, texts: DataFrame, links: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """More links, and pairs (a, b) that may be links, among members (head, cid, n, comp) of one head.

    Let `far` be a member's distance (size of the symmetric difference) from any fixed set C, here the consensus of the members. Two sets are linked if
    their distance is at most h * (n + n2), h = (den - num) / (den + num), and it is far + far2 - 2 * (marks in common). With x = far - h * n they are
    linked just if they have (x + x2) / 2 marks in common. So
     - where x + x2 <= 0 they are linked. Both are then linked to the member of least x, which is linked to all it can be so; full sets confirm these.
     - otherwise some of their marks must agree, and a prefix filter over marks finds them: a member looks among its rarest marks only, the fewer the
       larger x + x2 is. The farther of two looks for nearer ones level by level of x, which doubles from level to level; the nearer is found at its own.
    x is kept as an integer: x * (den + num)."""
    x = F.lit(num + den) * F.col("far") - F.lit(den - num) * F.col("n")
    near = differences(members, texts, width, consensus(members, texts, width)).withColumn("x", x)
    near = materialise(near, "dedup-marks")
    centre = near.groupBy("head").agg(F.min(F.struct("x", "cid")).alias("c")).select("head", F.col("c.x").alias("cx"), F.col("c.cid").alias("centre"))
    sure = near.join(centre, "head").where((F.col("x") + F.col("cx") <= 0) & (F.col("cid") != F.col("centre"))).select(F.col("centre").alias("a"), F.col("cid").alias("b")).distinct()
    sure = materialise(overlaps(sure, texts, width).where(F.lit(den) * F.col("shared") >= F.lit(num) * F.col("union")).select("a", "b"), "dedup-sure")
    comps = components(links.union(sure))
    near = near.drop("comp").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))

    unit = 2 * (num + den)
    marks = near.select("head", "cid", F.explode("marks").alias("r"))
    often = materialise(marks.groupBy("head", "r").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "dedup-often")
    by_member = Window.partitionBy("head", "cid")
    marks = marks.join(often, ["head", "r"]).withColumns({"most": F.count(F.lit(1)).over(by_member), "rank": F.row_number().over(by_member.orderBy("df", "r"))})
    marks = materialise(marks.select("head", "cid", "r", "most", "rank"), "dedup-ranked")
    level = F.signum("x") * F.floor(F.log2(F.lit(1) + F.abs("x") / unit))
    own = near.select("head", "cid", "x", "comp", level.cast("int").alias("level")).join(marks.where("rank = 1").select("head", "cid", "most"), ["head", "cid"])
    levels = own.groupBy("head", "level").agg(F.min("x").alias("lo"), F.min("comp").alias("first"), F.max("comp").alias("last"))
    agreed = lambda total: F.greatest(F.lit(1), F.ceil(total / unit))
    found = own.withColumn("deep", F.col("most") - agreed(2 * F.col("x")) + 1).where("deep > 0")
    seek = own.drop("level").join(levels, "head").where((F.col("lo") <= F.col("x")) & ((F.col("first") != F.col("comp")) | (F.col("last") != F.col("comp"))))
    seek = seek.withColumn("deep", F.col("most") - agreed(F.col("x") + F.col("lo")) + 1).where("deep > 0")
    place = lambda side: side.drop("most").join(marks, ["head", "cid"]).where("rank <= deep").select("head", "level", "r", "cid", "x", "comp", "most")
    second = place(found).select("head", "level", "r", *[F.col(c).alias(f"{c}2") for c in ("cid", "x", "comp", "most")])
    fits = (F.col("x2") <= F.col("x")) & (F.col("comp") != F.col("comp2")) & (F.col("x") + F.col("x2") <= F.lit(unit) * F.least("most", "most2"))
    pairs = place(seek).join(second, ["head", "level", "r"]).where(fits)
    return sure, pairs.select(F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b")).distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept."""
    rows = materialise(sketches(docs, width, num, den), "dedup-rows")
    some = rows.where("n_shingles > 0")
    classes = some.groupBy("cid").agg(F.min(F.struct(_least_id().alias("did"), "text_hash")).alias("rep"), F.min("doc_id").alias("least"), F.first("n_shingles").alias("n"), F.first("sketch").alias("sketch"))
    classes = materialise(classes, "dedup-classes")
    sketched, rows = rows, materialise(rows.drop("sketch"), "dedup-plain")
    release(sketched)

    # Inverted lists of retained values, and each class's rarest values. Counts are written, so that a crowded list is split like any skewed join.
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    often = materialise(values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "dedup-often")
    least = F.ceil(F.col("n") * num / den)  # size of the smallest set that can be linked, and of what they share
    wanted = F.least(least, F.greatest(F.lit(SHARED), F.ceil(F.lit(SHARE_OF) * least)))
    by_class = Window.partitionBy("cid")
    listed = values.join(often, "v").withColumns({"shared": F.count(F.lit(1)).over(by_class), "central": F.sum("df").over(by_class)}).withColumn("rank", F.row_number().over(by_class.orderBy("df", "v")))
    listed = listed.where(F.col("rank") <= F.col("shared") - wanted + 1).select("v", "cid", "n", "central")
    listed = listed_all = materialise(listed, "dedup-lists")
    involved = classes.join(listed.select("cid").distinct(), "cid", "left_semi")
    involved = materialise(involved.select("cid", "n", "rep.did", "rep.text_hash", "sketch"), "dedup-involved")
    texts = docs.select(_least_id().alias("did"), F.xxhash64("text").alias("text_hash"), "text").join(involved.select("cid", "did", "text_hash"), ["did", "text_hash"])
    texts = materialise(texts.dropDuplicates(["did", "text_hash"]).select("cid", "text"), "dedup-texts")

    owned = full_sets(texts, width).select("cid", F.explode("shingles").alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("c"), F.min("cid").alias("cid")).where("c = 1")
    owned = owned.groupBy("cid").agg(F.count(F.lit(1)).alias("own"))
    rest = involved.select("cid", "n").join(owned, "cid", "left").select("cid", (F.col("n") - F.coalesce("own", F.lit(0))).alias("rest"))
    listed = listed.join(rest, "cid").where(F.lit(den) * F.col("rest") >= F.lit(num) * F.col("n"))
    listed = materialise(listed.select("v", "cid", "n", "central"), "dedup-rare")
    release(often, listed_all)

    confirmed = F.lit(den) * F.col("shared") >= F.lit(num) * F.col("union")
    heads = listed.groupBy("v").agg(F.max(F.struct("central", "cid")).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1").select("v", F.col("l.cid").alias("head"))
    members = materialise(listed.join(materialise(heads, "dedup-heads"), "v"), "dedup-members")
    star = members.where("cid <> head").select(F.col("head").alias("a"), F.col("cid").alias("b")).distinct()
    star = materialise(estimated(star, involved, num, den), "dedup-star")
    links = materialise(overlaps(star, texts, width).where(confirmed).select("a", "b"), "dedup-links")
    comps = components(links)

    # Only members of lists that are still split go on, each once for the component of a head; the most central of them stands for that.
    named = comps.withColumnRenamed("node", "cid")
    members = members.join(named, "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    split = members.groupBy("v").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max(F.when(F.col("cid") == F.col("head"), F.col("comp"))).alias("group")).where("lo < hi").select("v", "group")
    members = materialise(members.join(materialise(split, "dedup-split"), "v").select("group", "cid", "n", "central", "comp").distinct(), "dedup-members")
    lead = members.groupBy("group").agg(F.max(F.struct("central", "cid")).alias("l")).select("group", F.col("l.cid").alias("head"))
    members = materialise(members.join(lead, "group").select("head", "cid", "n", "comp").distinct(), "dedup-members")
    sure, pairs = beyond_star(members, texts, links, width, num, den)
    links = links.union(sure)
    close = materialise(estimated(pairs, involved, num, den), "dedup-close")
    more = materialise(overlaps(close, texts, width).where(confirmed).select("a", "b"), "dedup-more")
    comps = components(links.union(more))

    named = classes.select("cid", "least").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    first = named.groupBy("comp").agg(F.min("least").alias("component_id"))
    named = named.join(first, "comp").select("cid", "component_id")
    out = rows.join(named, "cid", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "text_hash", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """docs, with all their columns, but one row of each group; repeated rows of the kept document go too."""
    i, h = free_name(docs, "id"), free_name(docs, "hash")
    kept = near_duplicates(docs, **how).where("kept").select(_least_id().alias(i), F.col("text_hash").alias(h)).distinct()
    named = docs.withColumns({i: _least_id(), h: F.xxhash64("text")})
    return named.join(kept, [i, h], "left_semi").dropDuplicates([i, h]).select(docs.columns)


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return near_duplicates(documents(spark, sf_dir), width=3, num=85, den=100).select("doc_id", "n_shingles", "component_id", "kept")
