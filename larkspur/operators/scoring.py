"""Scorers as plans: counts, decay, recency, co-visitation, TF-IDF profiles, factor models.

Every scorer keeps the label rows it is given and adds ``score``; what is unknown scores 0.0.
Only clicks strictly before a label's instant count.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions.columns import DAY_SECONDS, dot, seconds
from larkspur.operators.timeline import Series, attach_asof
from larkspur.sources.shared import dealt, staged

#: Words without a topic (fixed values).
STOP_TERMS = (
    "a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "have", "he", "her", "his", "in", "is", "it", "its", "of", "on", "or", "she",
    "that", "the", "they", "this", "to", "was", "were", "will", "with", "you", "your",
)

#: Terms of an item's title, about, for the number of tasks.
TERMS_A_TITLE = 10

MAX_GAP_SECONDS, MAX_RANK_GAP, TOP_RELATED, BACKWARD = 3600, 30, 50, 0.5


def click_counts(train: DataFrame) -> DataFrame:
    return train.where("clicked").groupBy("item_id").agg(F.count(F.lit(1)).alias("clicks"))


def popular(labels: DataFrame, train: DataFrame) -> DataFrame:
    """Clicks of the item in the training rows."""
    met = labels.join(click_counts(train), "item_id", "left")
    return met.withColumn("score", F.coalesce(F.col("clicks").cast("double"), F.lit(0.0))).drop("clicks")


def decayed(labels: DataFrame, clicks: DataFrame, half_life_days: float) -> DataFrame:
    """Sum of exp(-ln 2 x age / half-life) over the item's earlier clicks, linear in clicks and labels."""
    return decayed_sweep(labels, clicks, [half_life_days]).drop("half_life")


def decayed_sweep(labels: DataFrame, clicks: DataFrame, half_lives_days: Sequence[float]) -> DataFrame:
    """``labels`` once for each half-life, with half_life and the decayed sum of the item's earlier clicks as ``score``.

    Time is cut into blocks over which a weight falls by e^-30. Inside a block a running sum of
    weights counted from the block's start is exact to rounding, since all terms are positive.
    What earlier blocks leave is carried in from the 25 blocks before; beyond those a double's
    exponential is zero anyway. So a hot item costs a sort, not labels x clicks. Both inputs are
    read once, whatever the number of half-lives: rows are spread over them before they are sorted.
    """
    if not half_lives_days or min(half_lives_days) <= 0:
        raise ValueError("a half-life must be positive")
    rates = [(float(h), math.log(2) / (h * DAY_SECONDS)) for h in half_lives_days]
    spread = F.explode(F.array(*[F.struct(F.lit(h).alias("half_life"), F.lit(r).alias("rate"), F.lit(max(1, math.floor(30 / r))).cast("long").alias("block")) for h, r in rates]))

    def timed(df: DataFrame) -> DataFrame:
        out = df.withColumns({"__us": F.unix_micros("ts"), "__s": seconds(F.col("ts")), "__h": spread})
        return out.withColumn("__b", F.floor(F.col("__s") / F.col("__h.block"))).withColumn("__in", F.col("__s") - F.col("__b") * F.col("__h.block"))

    key = ["item_id", "__h", "__b"]
    rate, block = F.col("__h.rate"), F.col("__h.block")
    hits = timed(clicks.select("item_id", "ts")).groupBy(*key, "__us", "__in").agg(F.count(F.lit(1)).alias("__n"))
    hits = hits.withColumn("__w", F.col("__n") * F.exp(rate * F.col("__in")))
    totals = hits.groupBy(*key).agg(F.sum("__w").alias("__t"))
    reach = totals.select("item_id", "__h", "__t", F.explode(F.sequence(F.lit(1), F.lit(25))).alias("__d"), "__b")
    reach = reach.select("item_id", "__h", (F.col("__b") + F.col("__d")).alias("__b"), (F.col("__t") * F.exp(-rate * block * F.col("__d"))).alias("__c"))
    carry = reach.groupBy(*key).agg(F.sum("__c").alias("__carry"))
    own = F.struct(*[F.col(f"`{c}`") for c in labels.columns])
    both = timed(labels).select(*key, "__us", "__in", own.alias("__row")).unionByName(hits.select(*key, "__us", "__in", "__w"), allowMissingColumns=True)
    before = Window.partitionBy(*key).orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    both = both.withColumn("__sum", F.coalesce(F.sum("__w").over(before), F.lit(0.0))).where("__row is not null")
    both = both.join(carry, key, "left")
    score = F.exp(-rate * F.col("__in")) * (F.col("__sum") + F.coalesce("__carry", F.lit(0.0)))
    return both.select("__row.*", F.col("__h.half_life").alias("half_life"), score.alias("score"))


def recent(labels: DataFrame, clicks: DataFrame) -> DataFrame:
    """1 / (1 + days since the item's last earlier click), an as-of attachment: a click counts from the microsecond after it."""
    seen = clicks.select("item_id", (F.col("ts") + F.expr("INTERVAL 0.000001 SECOND")).alias("__from"), seconds(F.col("ts")).alias("__last"))
    met = attach_asof(labels, Series(seen, ("item_id",), "__from", ("__last",)))
    age = (seconds(F.col("ts")) - F.col("__last")) / float(DAY_SECONDS)
    return met.withColumn("score", F.coalesce(F.lit(1.0) / (1.0 + age), F.lit(0.0))).drop("__last")


#: Scorers by name: whether they take a value, written name@value, and how they score labels by training rows.
MODELS = {
    "popular": (False, lambda labels, train, value: popular(labels, train)),
    "recent": (False, lambda labels, train, value: recent(labels, train.where("clicked"))),
    "decayed": (True, lambda labels, train, value: decayed(labels, train.where("clicked"), value)),
}


def named(spec: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    """The scorer of a spec, as ``popular`` or ``decayed@3``: a function of labels and training rows."""
    name, at, text = spec.partition("@")
    if name not in MODELS:
        raise ValueError(f"unknown model {name}; there are {', '.join(sorted(MODELS))}")
    takes, score = MODELS[name]
    if takes != bool(at):
        raise ValueError(f"{name} needs a value, as {name}@3" if takes else f"{name} takes no value")
    value = float(text) if takes else None
    return lambda labels, train: score(labels, train, value)


def click_stream(rows: DataFrame) -> DataFrame:
    """A user's clicks numbered from 1 in order of time, impression and item."""
    order = Window.partitionBy("user_id").orderBy("ts", "impression_id", "item_id")
    return rows.where("clicked").select("user_id", "item_id", "impression_id", "ts", F.row_number().over(order).alias("rank"))


def covisit_edges(train: DataFrame, max_gap_seconds: float = MAX_GAP_SECONDS, max_rank_gap: int = MAX_RANK_GAP) -> DataFrame:
    """(item_id, related_item_id, weight) of items that a user clicked close to one another.

    Pairs lie within a rank gap, so clicks are cut into bands of that many ranks and a click meets
    only its own band and the next: an equi-join on (user, band) whose work is linear in a user's
    clicks. Never within one impression or one item; forward 1 / log2(2 + minutes), backward half.
    """
    if max_gap_seconds <= 0 or max_rank_gap <= 0:
        raise ValueError("gaps must be positive")
    clicks = click_stream(train).withColumn("band", F.floor(F.col("rank") / max_rank_gap))
    a = clicks.withColumn("band", F.explode(F.array("band", F.col("band") + 1))).alias("a")
    b = clicks.alias("b")
    gap = seconds(F.col("b.ts")) - seconds(F.col("a.ts"))
    on = (
        (F.col("a.user_id") == F.col("b.user_id")) & (F.col("a.band") == F.col("b.band")) & (F.col("b.rank") > F.col("a.rank")) & (F.col("b.rank") <= F.col("a.rank") + max_rank_gap)
        & (F.col("a.impression_id") != F.col("b.impression_id")) & (F.col("a.item_id") != F.col("b.item_id")) & (gap <= max_gap_seconds)
    )
    weight = F.lit(1.0) / F.log2(F.lit(2.0) + gap / 60.0)
    pairs = a.join(b, on).select(F.col("a.item_id").alias("x"), F.col("b.item_id").alias("y"), weight.alias("w"))
    ends = F.array(F.struct(F.col("x").alias("item_id"), F.col("y").alias("related_item_id"), F.col("w").alias("weight")), F.struct(F.col("y").alias("item_id"), F.col("x").alias("related_item_id"), (F.col("w") * BACKWARD).alias("weight")))
    return pairs.select(F.inline(ends)).groupBy("item_id", "related_item_id").agg(F.sum("weight").alias("weight"))


def strongest(edges: DataFrame, top: int = TOP_RELATED) -> DataFrame:
    """The ``top`` heaviest edges of each item with their rank; ties go to the smaller related item."""
    if top < 1:
        raise ValueError("top must be positive")
    order = Window.partitionBy("item_id").orderBy(F.round("weight", 9).desc(), "related_item_id")
    return edges.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def prior_clicks(labels: DataFrame, train: DataFrame) -> DataFrame:
    """Distinct (user_id, item_id, ts) clicked in training or among the labels."""
    part = [df.where("clicked").select("user_id", "item_id", "ts") for df in (train, labels)]
    return part[0].unionByName(part[1]).distinct()


_LABEL = ["impression_id", "item_id", "user_id", "ts"]


def _earlier_dot(asks: DataFrame, adds: DataFrame) -> DataFrame:
    """(impression_id, item_id, user_id, ts, dot): sum over keys of ``v`` x what the user's ``w`` of that key add up to before ts.

    ``asks`` has the label's columns, key and v; ``adds`` has user_id, key, ts and w. Both meet in
    one union that is sorted by (user, key, time) and summed on the way, so no label is multiplied
    by a user's earlier rows and a hot user's work is linear.
    """
    adds = adds.groupBy("user_id", "key", "ts").agg(F.sum("w").alias("w"))
    both = asks.withColumn("__us", F.unix_micros("ts")).unionByName(adds.withColumn("__us", F.unix_micros("ts")), allowMissingColumns=True)
    before = Window.partitionBy("user_id", "key").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1)
    met = both.withColumn("__sum", F.sum("w").over(before)).where("v is not null and __sum is not null")
    return met.groupBy(*_LABEL).agg(F.sum(F.col("v") * F.col("__sum")).alias("dot"))


def covisit(labels: DataFrame, train: DataFrame, edges: DataFrame) -> DataFrame:
    """Sum of edge weights from the user's strictly earlier clicks to the item.

    A click adds the weights of its item's edges, which ``strongest`` bounds, to the user's sums.
    """
    clicks = prior_clicks(labels, train)
    links = edges.select("item_id", F.col("related_item_id").alias("key"), F.col("weight").alias("w"))
    adds = clicks.join(links, "item_id").select("user_id", "key", "ts", "w")
    asks = labels.select(*_LABEL, F.col("item_id").alias("key"), F.lit(1.0).alias("v")).distinct()
    out = labels.join(_earlier_dot(asks, adds), _LABEL, "left")
    return out.withColumn("score", F.coalesce("dot", F.lit(0.0))).drop("dot")


def tokenize(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term), a row an occurrence: runs of a-z and 0-9 of two characters or more that carry a topic."""
    words = F.split(F.lower(F.coalesce(text_col, F.lit(""))), "[^a-z0-9]+")
    return rows.select(id_col, F.explode(words).alias("term")).where((F.length("term") >= 2) & ~F.col("term").isin(*STOP_TERMS))


def tfidf(rows: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, weight) with weight tf x ln(N / df), unsmoothed."""
    tf = tokenize(rows, id_col, text_col).groupBy(id_col, "term").agg(F.count(F.lit(1)).cast("double").alias("tf"))
    df = staged(tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "terms")  # of known size: a small vocabulary is sent to the rows, not the rows to it
    n = rows.agg(F.count_distinct(id_col).cast("double").alias("n"))
    met = tf.join(df, "term").join(F.broadcast(n))  # one row
    return met.select(id_col, "term", (F.col("tf") * F.log(F.col("n") / F.col("df"))).alias("weight"))


def content(labels: DataFrame, train: DataFrame, catalogue: DataFrame, text_col: str = "title") -> DataFrame:
    """Cosine of the item's terms and the summed terms of the user's strictly earlier clicks.

    The profile is never built: its product with an item is a running sum by (user, term), and its
    squared length grows with each click by 2 S w + w^2, where S is the term's sum before it.

    Labels and clicks meet their item's terms once and are dealt by user once; what follows stays in
    that task. The number of tasks follows the number of terms, so that a task's memory doesn't grow.
    """
    texts = dealt(catalogue.select("item_id", text_col), catalogue.count() * TERMS_A_TITLE, "item_id")
    weights = tfidf(texts, "item_id", text_col).where("weight <> 0")
    terms = staged(weights.groupBy("item_id").agg(F.collect_list(F.struct(F.col("term").alias("__key"), F.col("weight").alias("__w"))).alias("__terms"), F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__n")), "item-terms")
    hit = F.coalesce(F.col("clicked") & F.col("user_id").isNotNull() & F.col("ts").isNotNull(), F.lit(False)).alias("__hit")
    own = F.struct(*[F.col(f"`{c}`") for c in labels.columns]).alias("__row")
    rows = labels.select("user_id", "ts", "item_id", hit, own).unionByName(train.where("clicked").select("user_id", "ts", "item_id", hit), allowMissingColumns=True)
    n, width = rows.count(), terms.agg(F.avg(F.size("__terms"))).first()[0] or 1.0
    met = dealt(rows, n, "item_id").join(terms, "item_id", "left")
    # Labels and clicks of one user, instant and item are one row, whose score they share.
    met = dealt(met.withColumn("__us", F.unix_micros("ts")), math.ceil(n * max(1.0, width)), "user_id").groupBy("user_id", "__us", "item_id")
    one = met.agg(F.bool_or("__hit").alias("__hit"), F.collect_list("__row").alias("__rows"), F.first("__terms").alias("__terms"), F.first("__n").alias("__n"))
    time = Window.partitionBy("user_id", "__key").orderBy("__us")
    spread = one.select("user_id", "__us", "item_id", "__hit", "__rows", "__n", F.inline_outer("__terms"))
    added = F.when(F.col("__hit"), F.col("__w"))
    spread = spread.withColumns({"__before": F.sum(added).over(time.rangeBetween(Window.unboundedPreceding, -1)), "__now": F.sum(added).over(time.rangeBetween(0, 0))})
    grown = added * (2 * F.coalesce("__before", F.lit(0.0)) + F.col("__now"))
    back = spread.groupBy("user_id", "__us", "item_id").agg(F.first("__rows").alias("__rows"), F.first("__n").alias("__n"), F.sum(F.col("__w") * F.col("__before")).alias("__dot"), F.sum(grown).alias("__grown"))
    length = F.sum("__grown").over(Window.partitionBy("user_id").orderBy("__us").rangeBetween(Window.unboundedPreceding, -1))
    score = F.coalesce(F.try_divide("__dot", F.col("__n") * F.sqrt("__length")), F.lit(0.0))
    return back.withColumn("__length", length).where(F.size("__rows") > 0).select(F.inline("__rows"), score.alias("score"))


def als_factors(train: DataFrame, rank: int = 32, reg: float = 0.1, iterations: int = 10, alpha: float = 40.0, seed: int = 42):
    """A fitted implicit-feedback factor model on click counts."""
    from pyspark.ml.recommendation import ALS

    if rank < 1:
        raise ValueError("rank must be positive")
    counts = train.where("clicked").groupBy("user_id", "item_id").agg(F.count(F.lit(1)).cast("float").alias("n"))
    if {"string", "binary"} & {kind for name, kind in train.dtypes if name in ("user_id", "item_id")}:
        raise ValueError("ids that are no numbers: number them densely first (transform.dense_ids)")
    wide = counts.agg(F.max(F.greatest(F.abs("user_id"), F.abs("item_id"))).alias("m")).first()["m"]
    if wide is not None and wide > 2**31 - 1:
        raise ValueError("ids beyond 32 bits: number them densely first (transform.dense_ids)")
    ids = counts.select(F.col("user_id").cast("int"), F.col("item_id").cast("int"), "n")
    return ALS(rank=rank, regParam=reg, maxIter=iterations, alpha=alpha, implicitPrefs=True, userCol="user_id", itemCol="item_id", ratingCol="n", coldStartStrategy="nan", seed=seed).fit(ids)


def als(labels: DataFrame, model) -> DataFrame:
    """Inner product of user and item factors."""
    users = model.userFactors.select(F.col("id").cast("long").alias("user_id"), F.col("features").alias("__u"))
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.col("features").alias("__i"))
    met = labels.join(users, "user_id", "left").join(items, "item_id", "left")
    return met.withColumn("score", F.coalesce(F.nanvl(dot(F.col("__u"), F.col("__i")), F.lit(0.0)), F.lit(0.0))).drop("__u", "__i")


def als_items(labels: DataFrame, train: DataFrame, model) -> DataFrame:
    """Sum of item-item products with the user's strictly earlier clicks: the item against one running sum a dimension."""
    items = model.itemFactors.select(F.col("id").cast("long").alias("item_id"), F.posexplode("features").alias("key", "v"))
    adds = prior_clicks(labels, train).join(items, "item_id").select("user_id", "key", "ts", F.col("v").cast("double").alias("w"))
    asks = labels.select(*_LABEL).distinct().join(items, "item_id").select(*_LABEL, "key", F.col("v").cast("double").alias("v"))
    out = labels.join(_earlier_dot(asks, adds), _LABEL, "left")
    return out.withColumn("score", F.coalesce("dot", F.lit(0.0))).drop("dot")
