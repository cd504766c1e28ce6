"""Exact grouped quantiles by histogram refinement.

No sort, no list of a group's values. One map-side aggregate counts every
group's values by narrow steps of their logarithm and keeps each step's count,
least and largest value; prefix sums over a group's steps name the steps that
hold the wanted ranks. A step with one value is done. The values of the other
steps, about one in a hundred, are counted one by one; a step that still holds
too many is first cut into equal parts of its range, as often as it takes, so
that the rows of a hot group never meet in one task. All probabilities, value
columns and groups go through the same passes. Interpolation is linear between
the closest ranks (numpy's default and DuckDB's ``quantile_cont``)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .stage import write_stage

#: Steps an octave of the first pass, parts of a step in later ones, and the rows of a step that are counted one by one.
STEPS, PARTS, FEW = 64, 4096, 100_000


def _step(v: Column) -> Column:
    """Narrow steps of a value's logarithm, in order for either sign."""
    return (F.signum(v) * F.floor(F.log2(F.abs(v) * 1e6 + 1) * STEPS)).cast("long")


def _same(a: DataFrame, b: DataFrame, names: list[str]) -> Column:
    return reduce(lambda x, y: x & y, [a[n].eqNullSafe(b[f"r_{n}"]) for n in names])


def _quantiles(df: DataFrame, keys: list[str], values: list[str], wanted: list[tuple[int, str, float]],
               weight: str | None = None, leave_out: tuple[str, int] | None = None) -> DataFrame:
    """One column for each ``(place in values, name, probability)`` by key."""
    ks = [f"k{i}" for i in range(len(keys))]
    w = (F.col(weight) if weight else F.lit(1)).cast("long")
    fold = F.col(leave_out[0]) if leave_out else F.lit(0)
    stacked = F.array(*[F.struct(F.lit(i).alias("c"), F.col(v).cast("double").alias("v")) for i, v in enumerate(values)])
    base = df.select(*[F.col(k).alias(n) for k, n in zip(keys, ks)], w.alias("w"), fold.alias("f"), F.explode(stacked).alias("x")) \
        .select(*ks, "w", "f", "x.c", "x.v").where(F.col("v").isNotNull() & ~F.isnan("v"))
    groups = [*ks, "c"]
    if leave_out:
        groups = ["k", *groups]

    def spread(counts: DataFrame) -> DataFrame:
        """Counts by fold, given to every ``k`` that leaves the fold in."""
        if not leave_out:
            return counts
        others = F.filter(F.sequence(F.lit(0), F.lit(leave_out[1] - 1)), lambda k: k != F.col("f"))
        return counts.withColumn("k", F.explode(others))

    def merged(counts: DataFrame, by: list[str]) -> DataFrame:
        if not leave_out:
            return counts
        return spread(counts).groupBy("k", *by).agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi"))

    def counted(rows: DataFrame, by: list[str]) -> DataFrame:
        first = by if not leave_out else [*by, "f"]
        return merged(rows.groupBy(*first).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), by)

    def picked(steps: DataFrame, part: list[str], start: Column) -> DataFrame:
        """The steps that hold a wanted rank: ``rank`` and ``before``, the
        number of values below the step."""
        order = Window.partitionBy(*part).orderBy("lo")
        return steps.withColumn("before", start + F.sum("n").over(order) - F.col("n"))

    def ranks(total: Column) -> Column:
        by_column = [F.array(*[F.floor(F.lit(float(p)) * (total - 1)).cast("long") for i, _, p in wanted if i == c]
                             + [F.ceil(F.lit(float(p)) * (total - 1)).cast("long") for i, _, p in wanted if i == c])
                     for c in range(len(values))]
        return F.array_distinct(F.element_at(F.array(*by_column), F.col("c") + 1))

    steps = counted(base.withColumn("b", _step(F.col("v"))), [*ks, "c", "b"])
    steps = picked(steps, groups, F.lit(0)).withColumn("total", F.sum("n").over(Window.partitionBy(*groups)))
    held = steps.withColumn("rank", F.explode(F.filter(ranks(F.col("total")), lambda r: (r >= F.col("before")) & (
        r < F.col("before") + F.col("n"))))).select(*groups, "total", "rank", "before", "n", "lo", "hi")
    held = write_stage(held.coalesce(8), "ranks")  # two rows a group and probability
    done = held.where("lo = hi").select(*groups, "total", "rank", F.col("lo").alias("v"))
    while True:
        most = held.where("lo < hi").agg(F.max("n")).first()[0]
        if most is None:
            break
        spans = held.where("lo < hi").select(*groups, "before", "lo", "hi").distinct()
        names = [g for g in groups if g != "k"]
        r = spans.select(*[F.col(x).alias(f"r_{x}") for x in spans.columns])
        inside = _same(base, r, names) & (base["v"] >= r["r_lo"]) & (base["v"] <= r["r_hi"])
        if leave_out:
            inside = inside & (base["f"] != r["r_k"])
        rows = base.join(r, inside).drop(*ks, "c", "f")
        few = most <= FEW
        b = F.col("v") if few else F.floor((F.col("v") - F.col("r_lo")) / (F.col("r_hi") - F.col("r_lo")) * PARTS)
        span = [f"r_{x}" for x in spans.columns]
        steps = rows.groupBy(*span, b.alias("b")).agg(F.sum("w").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
        steps = picked(steps, span, F.col("r_before"))
        on = [f"r_{g}" for g in groups] + ["r_before"]
        need = held.where("lo < hi").select(*groups, "total", "rank", F.col("before").alias("b0"))
        same = reduce(lambda x, y: x & y, [need[g].eqNullSafe(steps[f"r_{g}"]) for g in groups]) & (need["b0"] == steps["r_before"])
        got = steps.join(need, same).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("n"))) \
            .select(*groups, "total", "rank", "before", "n", "lo", "hi").drop(*on)
        held = write_stage(got.coalesce(8), "ranks")
        done = done.unionByName(held.where("lo = hi").select(*groups, "total", "rank", F.col("lo").alias("v")))
    out = []
    at = lambda c, x: F.max(F.when((F.col("c") == c) & (F.col("rank") == x.cast("long")), F.col("v")))
    aggs = []
    for j, (c, name, p) in enumerate(wanted):
        x = F.lit(float(p)) * (F.col("total") - 1)
        aggs += [at(c, F.floor(x)).alias(f"lo{j}"), at(c, F.ceil(x)).alias(f"hi{j}"),
                 F.max(F.when(F.col("c") == c, x)).alias(f"x{j}")]
        lo, hi, pos = F.col(f"lo{j}"), F.col(f"hi{j}"), F.col(f"x{j}")
        out.append(F.when(lo == hi, lo).otherwise((F.ceil(pos) - pos) * lo + (pos - F.floor(pos)) * hi).alias(name))
    by = [g for g in groups if g != "c"]
    back = [F.col(n).alias(k) for n, k in zip(ks, keys)] + ([F.col("k").alias("k")] if leave_out else [])
    return done.groupBy(*by).agg(*aggs).select(*back, *out)


def weighted_quantiles(df: DataFrame, keys: list[str], value: str, named_probs: list[tuple[str, float]],
                       weight: str | None = None, leave_out: tuple[str, int] | None = None) -> DataFrame:
    """Keys and one column per (name, probability): exact quantiles of
    ``value`` per ``keys``; NULL and NaN values are ignored. With ``weight``
    (a count), a row stands for that many equal values. With ``leave_out``
    (column, m) there is a result for each ``k`` below m (a further key), over
    the rows whose column is not k: all folds from counts made once."""
    return _quantiles(df, keys, [value], [(0, n, p) for n, p in named_probs], weight, leave_out)


def grouped_stats(df: DataFrame, keys: list[str], aggs: list[Column],
                  quantiles: list[tuple[str, str, float]]) -> DataFrame:
    """``groupBy(keys).agg(*aggs, <quantiles>)`` with exact quantiles.

    ``quantiles`` holds (output name, value column, probability)."""
    out = df.groupBy(*keys).agg(*aggs) if aggs else df.select(*keys).distinct() if keys else None
    values = list(dict.fromkeys(v for _, v, _ in quantiles))
    q = _quantiles(df, keys, values, [(values.index(v), n, p) for n, v, p in quantiles])
    names = [n for n, _, _ in quantiles]
    if not keys:
        return q.select(*names) if out is None else out.crossJoin(q.select(*names))  # one row each
    q = q.select(*[F.col(k).alias(f"r_{k}") for k in keys], *names)
    return out.join(q, _same(out, q, keys), "left").drop(*[f"r_{k}" for k in keys])
