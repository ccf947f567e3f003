"""Drift, skew and exposure monitoring."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import ratio
from larkspur.operators.ranges import numbered, quantiles, quantiles_of, with_offsets
from larkspur.sources.shared import staged

PSI_BINS, PSI_FLOOR, WATCH, SKEW = 10, 1e-6, 0.1, 0.25


def band(psi: Column) -> Column:
    return F.when(psi > SKEW, "SKEW").when(psi > WATCH, "WATCH").otherwise("OK")


def baseline(rows: DataFrame, features: Sequence[str], bins: int = PSI_BINS) -> DataFrame:
    """(feature, edges): the distinct quantile edges of each feature; null where it has no value."""
    return _edges(quantiles(_long(rows, features), [i / bins for i in range(bins + 1)]), features)


def _edges(found: DataFrame, features: Sequence[str]) -> DataFrame:
    every = found.sparkSession.createDataFrame([(f,) for f in features], "feature string")
    return every.join(F.broadcast(found), "feature", "left").select("feature", F.array_distinct("values").alias("edges"))  # a row a feature


def _long(rows: DataFrame, features: Sequence[str]) -> DataFrame:
    return rows.select(F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x")) for f in features]))).where("x is not null")


def shares(rows: DataFrame, features: Sequence[str], edges: DataFrame) -> DataFrame:
    """(feature, bin, n): counts per bin; values beyond the outer edges fall in the end bins, the last edge in the last bin.

    A constant has one edge: bin 0 holds what equals it and bin 1 all else.
    """
    met = _long(rows, features).join(F.broadcast(edges), "feature")  # a row per feature
    return met.withColumn("bin", _bin()).groupBy("feature", "bin").agg(F.count(F.lit(1)).alias("n"))


def _bin() -> Column:
    place = F.size(F.filter("edges", lambda e: e <= F.col("x"))) - 1
    last = F.size("edges") - 2
    return F.when(F.size("edges") == 1, (F.get("edges", F.lit(0)) != F.col("x")).cast("int")).otherwise(F.greatest(F.lit(0), F.least(place, last)))


def psi(expected: DataFrame, actual: DataFrame, features: Sequence[str]) -> DataFrame:
    """(feature, psi, band) of the actual rows on the expected rows' bins; infinite for a constant that moved.

    A constant has no bins that could say how far it moved, so its index is 0 or infinite.
    """
    # Each side is read once: equal values are counted together, and edges and bins come of the counts.
    both = _long(expected, features).withColumn("side", F.lit(True)).unionByName(_long(actual, features).withColumn("side", F.lit(False)))
    counts = staged(both.groupBy("feature", "x").agg(F.count_if("side").alias("n_e"), F.count_if(~F.col("side")).alias("n_a")), "psi-values")
    found = quantiles_of(counts.where("n_e > 0").select("feature", "x", F.col("n_e").alias("__n")), [i / PSI_BINS for i in range(PSI_BINS + 1)])
    edges = staged(_edges(found, features), "psi-edges")  # a row a feature, used three times
    every = edges.select("feature", (F.size("edges") == 1).alias("constant"), F.explode(F.sequence(F.lit(0), F.greatest(F.size("edges") - 2, F.lit(0)))).alias("bin"))
    moved = edges.where(F.size("edges") == 1).select("feature", F.lit(True).alias("constant"), F.lit(1).alias("bin"))
    told = counts.join(F.broadcast(edges), "feature").withColumn("bin", _bin()).groupBy("feature", "bin").agg(F.sum("n_e").alias("n_e"), F.sum("n_a").alias("n_a"))
    out = every.unionByName(moved).join(told, ["feature", "bin"], "left")
    whole = Window.partitionBy("feature")
    for name in ("e", "a"):
        n = F.coalesce(F.col(f"n_{name}"), F.lit(0))
        out = out.withColumn(name, F.greatest(n / F.greatest(F.sum(n).over(whole), F.lit(1)), F.lit(PSI_FLOOR)))
    value = F.sum((F.col("a") - F.col("e")) * F.log(F.col("a") / F.col("e")))
    jumped = F.coalesce(F.max(F.when(F.col("constant") & (F.col("bin") == 1), F.col("n_a"))), F.lit(0)) > 0
    value = F.when(F.bool_or("constant"), F.when(jumped, F.lit(float("inf"))).otherwise(F.lit(0.0))).otherwise(value)
    return out.groupBy("feature").agg(value.alias("psi")).withColumn("band", band(F.col("psi")))


def kolmogorov_smirnov(a: DataFrame, b: DataFrame, column: str) -> DataFrame:
    """One row (ks): the largest distance of two distribution functions.

    Equal values are counted together first; the ordered window goes over ranges of values, each
    offset by the ranges below it.
    """
    both = a.select(F.col(column).alias("x"), F.lit(1).alias("na"), F.lit(0).alias("nb")).unionByName(b.select(F.col(column).alias("x"), F.lit(0).alias("na"), F.lit(1).alias("nb")))
    per = both.where("x is not null").groupBy("x").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    met = with_offsets(per, ["x"], {"oa": F.col("na"), "ob": F.col("nb")}, totals=True)
    run = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, 0)
    met = met.withColumns({f"c{n}": F.sum(f"n{n}").over(run) + F.col(f"o{n}") for n in "ab"})
    cdf = lambda n: F.try_divide(F.col(f"c{n}"), F.col(f"o{n}_total"))
    return met.agg(F.max(F.abs(cdf("a") - cdf("b"))).alias("ks"))


def skew(rows: DataFrame, expected_width: int) -> DataFrame:
    """One row of what was served: kept rows, and those left out as degraded, not found, or of another width."""
    bad_width = F.size("features") != expected_width
    return rows.agg(
        F.count(F.lit(1)).alias("served"), F.count_if("degraded").alias("degraded"), F.count_if(~F.col("degraded") & ~F.col("found")).alias("not_found"),
        F.count_if(~F.col("degraded") & F.col("found") & bad_width).alias("wrong_width"), F.count_if(~F.col("degraded") & F.col("found") & ~bad_width).alias("kept"),
    )


def last_rows(rows: DataFrame, n: int, order: Sequence[str], least: int = 0) -> DataFrame:
    """The n last rows by ``order``; none where there are fewer than ``least``."""
    if n < 1:
        raise ValueError("n must be positive")
    top = rows.orderBy(*[F.col(c).desc() for c in order]).limit(n)
    return top.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy())).where(F.col("__n") >= least).drop("__n") if least else top


def exposure_windows(exposures: DataFrame, size: int, order: Sequence[str], item: str, catalogue_size: int | None = None) -> DataFrame:
    """(window, exposures, distinct_items, gini_catalogue, gini_observed) of blocks of ``size`` exposures; a partial block is left out."""
    if size < 1:
        raise ValueError("size must be positive")
    blocks = numbered(exposures, order).withColumn("window", F.floor(F.col("position") / size))
    counts = blocks.groupBy("window", item).agg(F.count(F.lit(1)).alias("x"))
    place = F.row_number().over(Window.partitionBy("window").orderBy("x", item))
    per = counts.withColumn("i", place).groupBy("window").agg(F.sum("x").alias("exposures"), F.count(F.lit(1)).alias("distinct_items"), F.sum(F.col("i") * F.col("x")).alias("ix"))
    per = per.where(F.col("exposures") == size)

    def gini(n: Column) -> Column:
        ranks = F.col("ix") + (n - F.col("distinct_items")) * F.col("exposures")
        return ratio(2 * ranks - (n + 1) * F.col("exposures"), n * F.col("exposures"))

    whole = F.col("distinct_items") if catalogue_size is None else F.lit(catalogue_size)
    return per.select("window", "exposures", "distinct_items", gini(whole).alias("gini_catalogue"), gini(F.col("distinct_items")).alias("gini_observed"))


def alerts(metrics: DataFrame, rules: Sequence[tuple[str, str, float, str]]) -> DataFrame:
    """(metric, value, severity) of metrics over the threshold of a rule (metric, sign, threshold, severity)."""
    out = F.lit(None).cast("string")
    for name, sign, threshold, severity in rules:
        if sign not in (">", "<"):
            raise ValueError(f"unknown sign {sign}")
        value = F.col("value")
        fires = (F.col("metric") == name) & ((value > threshold) if sign == ">" else (value < threshold))
        out = F.coalesce(F.when(fires, severity), out)
    return metrics.withColumn("severity", out).where("severity is not null")


def decayed_frequency(rows: DataFrame, item: str, step: str, decay: float) -> DataFrame:
    """(item, frequency): counts that lose a factor ``decay`` with every later step, as one aggregate."""
    if not 0 < decay <= 1:
        raise ValueError("decay must lie in (0, 1]")
    last = rows.agg(F.max(step).alias("__last"))
    weight = F.exp(F.lit(math.log(decay)) * (F.col("__last") - F.col(step)))
    return rows.join(F.broadcast(last)).groupBy(item).agg(F.sum(weight).alias("frequency"))  # one row


#: Half-lives a block of the log-q estimate spans, and blocks back whose counts still matter to a double.
SPAN, BACK = 32, 3
#: Points at which sketches of two spans are compared; they add half of 1 / GRID to the sketches' rank error.
GRID = 1000


def log_q(rows: DataFrame, item: str, step: str, half_life: float, n_items: int, prior: float = 1.0) -> DataFrame:
    """(step, item, log_q): the log sampling probability of each step's items as of before the step.

    A step's rows count once they are past: an observation halves with every ``half_life`` rows of the
    steps after its own. The prior, a pseudo-count an item, stays outside the decay, so what was never
    seen keeps prior / (prior x n_items + all).

    Steps are placed by how many rows came up to them, and places are cut into blocks of ``SPAN``
    half-lives: a sum inside the block and the sums of ``BACK`` blocks before it, so an item's steps
    are met once each.
    """
    if half_life <= 0 or prior <= 0 or n_items < 1:
        raise ValueError("half_life, prior and n_items must be positive")
    width = SPAN * half_life
    counts = staged(rows.groupBy(F.col(step).alias("step"), F.col(item).alias("item")).agg(F.count(F.lit(1)).alias("n")), "logq-counts")
    sizes = with_offsets(counts.groupBy("step").agg(F.sum("n").alias("n")), ["step"], {"__before": F.col("n")})
    run = Window.partitionBy("part").orderBy("step").rowsBetween(Window.unboundedPreceding, 0)
    places = sizes.select("step", (F.col("__before") + F.sum("n").over(run)).alias("to"), "n").select("step", (F.col("to") - F.col("n")).alias("from"), "to", "n")
    places = staged(places, "logq-places")

    def observed(hits: DataFrame, asks: DataFrame, keys: list[str]) -> DataFrame:
        """``asks`` (keys, at) with the decayed count of ``hits`` (keys, at, n) at or before them."""
        block = lambda df: df.withColumn("b", F.floor(F.col("at") / width))
        inside = F.pow(F.lit(2.0), (F.col("at") - F.col("b") * width) / half_life)
        hits = block(hits).withColumn("w", F.col("n") * inside)
        totals = hits.groupBy(*keys, "b").agg(F.sum("w").alias("t")).select(*keys, "t", "b", F.explode(F.sequence(F.lit(1), F.lit(BACK))).alias("d"))
        carry = totals.groupBy(*keys, (F.col("b") + F.col("d")).alias("b")).agg(F.sum(F.col("t") * F.pow(F.lit(2.0), -SPAN * F.col("d"))).alias("carry"))
        both = block(asks).withColumn("ask", F.lit(True)).unionByName(hits.select(*keys, "at", "b", "w"), allowMissingColumns=True)
        upto = Window.partitionBy(*keys, "b").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
        met = both.withColumn("s", F.coalesce(F.sum("w").over(upto), F.lit(0.0))).where("ask").join(carry, [*keys, "b"], "left")
        return met.withColumn("seen", (F.col("s") + F.coalesce("carry", F.lit(0.0))) / inside).drop("b", "w", "s", "carry", "ask")

    placed = counts.join(places.drop("n"), "step")
    own = observed(placed.select("item", F.col("to").alias("at"), "n"), placed.select("step", "item", F.col("from").alias("at")), ["item"])
    one = F.lit(0).alias("k")
    every = observed(places.select(one, F.col("to").alias("at"), "n"), places.select(one, "step", F.col("from").alias("at")), ["k"])
    met = own.join(every.select("step", F.col("seen").alias("whole")), "step")
    return met.select("step", "item", F.ln((F.lit(float(prior)) + F.col("seen")) / (F.lit(float(prior * n_items)) + F.col("whole"))).alias("log_q"))


def daily_sketches(rows: DataFrame, features: Sequence[str], ts: str = "ts", k: int = 800) -> DataFrame:
    """(day, feature, n, sketch): a mergeable quantile sketch of each feature's values of each day."""
    long = rows.select(F.to_date(ts).alias("day"), F.inline(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x")) for f in features]))).where("x is not null and not isnan(x)")
    return long.groupBy("day", "feature").agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double("x", F.lit(k)).alias("sketch"))


def merged_sketches(sketches: DataFrame, first: str, last: str) -> DataFrame:
    """(feature, n, sketch) of the days ``first`` to ``last``, both included; the rows themselves aren't read."""
    days = sketches.where(F.col("day").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return days.groupBy("feature").agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))


def sketch_edges(merged: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, edges): distinct quantile edges from sketches, within the sketch's rank error of those of ``baseline``."""
    points = F.array(*[F.lit(i / bins) for i in range(bins + 1)])
    return merged.select("feature", F.array_distinct(F.kll_sketch_get_quantile_double("sketch", points)).alias("edges"))


def sketch_psi(expected: DataFrame, actual: DataFrame, bins: int = PSI_BINS) -> DataFrame:
    """(feature, psi, band) of two merged sketches: shares between the expected edges are differences of ranks."""
    met = expected.select("feature", F.col("sketch").alias("e")).join(sketch_edges(expected, bins), "feature").join(actual.select("feature", F.col("sketch").alias("a")), "feature")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))

    # Ranks of values that differ from row to row, from quantiles at fixed points.
    points = F.array(*[F.lit((i + 0.5) / GRID) for i in range(GRID)])

    def shares(sketch: str) -> Column:
        grid = F.kll_sketch_get_quantile_double(sketch, points)
        below = F.transform(inner, lambda e: F.size(F.filter(grid, lambda x: x < e)) / F.lit(float(GRID)))
        cuts = F.concat(F.array(F.lit(0.0)), below, F.array(F.lit(1.0)))
        return F.zip_with(F.slice(cuts, 1, F.size(cuts) - 1), F.slice(cuts, 2, F.size(cuts) - 1), lambda a, b: F.greatest(b - a, F.lit(PSI_FLOOR)))

    terms = F.zip_with(shares("e"), shares("a"), lambda e, a: (a - e) * F.ln(a / e))
    value = F.aggregate(terms, F.lit(0.0), lambda total, x: total + x)
    return met.select("feature", value.alias("psi")).withColumn("band", band(F.col("psi")))
