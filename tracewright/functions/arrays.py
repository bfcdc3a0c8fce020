"""Array and number functions, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def jaccard(a: Column, b: Column, both_empty: float = 1.0) -> Column:
    n = F.size(F.array_union(a, b))
    return F.when(n == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / n)


def weights_to_length(w: Column, n: Column) -> Column:
    """Padded with 1e-8 or cut to n, then scaled to sum 1; uniform where the sum isn't positive."""
    w = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.coalesce(F.get(w, i - 1), F.lit(1e-8)))
    total = F.aggregate(w, F.lit(0.0), lambda a, x: a + x)
    return F.when(n <= 0, F.array().cast("array<double>")).otherwise(F.transform(w, lambda x: F.when(total > 0, x / total).otherwise(1.0 / F.size(w))))


def bucket(y: Column, edges: list[float]) -> Column:
    """Index of the first edge that isn't below y; above the last edge, the last class."""
    out = F.lit(len(edges) - 1)
    for i in range(len(edges) - 1, -1, -1):
        out = F.when(y <= F.lit(float(edges[i])), F.lit(i)).otherwise(out)
    return out


def centres(edges: list[float]) -> list[float]:
    return [(a + b) / 2 for a, b in zip([0.0, *edges[:-1]], edges, strict=True)]


def three_quotas(a: Column, b: Column, c: Column, budget: Column) -> Column:
    """Tokens for three segments: shares 4:4:2 with 8 at least, then the rest to the longest remainder, ties in order."""
    share = [F.greatest(F.lit(8), F.floor(budget * s / 10)).cast("int") for s in (4, 4, 2)]
    first = [F.least(n, s) for n, s in zip((a, b, c), share, strict=True)]
    state = F.struct(*[x.cast("int").alias(f"x{i}") for i, x in enumerate(first)], (budget - first[0] - first[1] - first[2]).cast("int").alias("left"))

    def give(s: Column, _: Column) -> Column:
        lack = [n - s[f"x{i}"] for i, n in enumerate((a, b, c))]
        most = F.greatest(*lack)
        who = F.when(lack[0] == most, 0).when(lack[1] == most, 1).otherwise(2)
        add = F.greatest(F.lit(0), F.least(most, s["left"]))
        return F.struct(*[(s[f"x{i}"] + F.when(who == i, add).otherwise(0)).cast("int").alias(f"x{i}") for i in range(3)], (s["left"] - add).cast("int").alias("left"))

    return F.aggregate(F.array(F.lit(0), F.lit(1), F.lit(2)), state, give)


def cheap_score(rel_pos: Column, length: Column, boxed: Column) -> Column:
    return F.round(F.least(F.lit(1.0), 0.2 * rel_pos + 0.15 * F.least(F.lit(1.0), length / 120.0) + 0.1 * boxed), 3)


def masked_mean(vectors: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is 1; the count is 1e-6 at least."""
    zero = F.transform(F.get(vectors, 0), lambda _: F.lit(0.0))
    pair = F.arrays_zip(vectors.alias("v"), mask.alias("m"))
    total = F.aggregate(pair, zero, lambda acc, x: F.zip_with(acc, x["v"], lambda p, q: p + q.cast("double") * x["m"].cast("double")))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda acc, x: acc + x.cast("double")), F.lit(1e-6))
    return F.transform(total, lambda x: x / n)


def mean_finite(x: Column) -> Column:
    ok = F.filter(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return F.when(F.size(ok) > 0, F.aggregate(ok, F.lit(0.0), lambda a, v: a + v) / F.size(ok)).otherwise(F.lit(float("nan")))


def head_tail_steps(steps: Column, sizes: Column, budget: int | Column) -> Column:
    """Struct kept, n_head, n_tail: leading steps while they fit the budget, then trailing ones in what is left. sizes: array<long>, one for each step."""

    def fitting(a: Column, room: Column) -> Column:
        start = F.struct(F.lit(0).cast("long").alias("used"), F.lit(0).alias("n"), F.lit(True).alias("open"))

        def add(s, x):
            fits = s["open"] & (s["used"] + x <= room)
            return F.struct(F.when(fits, s["used"] + x).otherwise(s["used"]).alias("used"), F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), fits.alias("open"))

        return F.aggregate(a, start, add)

    budget = F.lit(budget) if isinstance(budget, int) else budget
    head = fitting(sizes, budget.cast("long"))
    rest = F.reverse(F.slice(sizes, head["n"] + 1, F.size(sizes)))
    tail = fitting(rest, budget.cast("long") - head["used"])
    kept = F.concat(F.slice(steps, F.lit(1), head["n"]), F.slice(steps, F.size(steps) - tail["n"] + 1, tail["n"]))
    return F.struct(kept.alias("kept"), head["n"].alias("n_head"), tail["n"].alias("n_tail"))
