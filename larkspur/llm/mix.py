"""Mixing sources to target weights by Poisson replication.

Each source gets a mean repetition rate, target weight x target rows / rows of the source. Every
document draws its number of copies from the Poisson distribution of that mean by inverting the
distribution function at a uniform number taken from a hash of (seed, id), so a re-run task
draws the same number again. A mean above ``MAX_RATE`` is drawn as the sum of equal parts, each
at a number of its own from the hash of (seed, id, part): a sum of Poisson counts has the Poisson
distribution of the summed mean, so no rate is cut. Documents are exploded by their count and
shuffled globally on a hash of (seed, id, copy). The hash is uniform, so a row's range follows from
its leading digits: no pass over the rows is needed to find the ranges.

Defined results: a null source is a source of its own; null or empty texts are replicated like
others; repeated rows draw the same count each; a document without an id draws from a hash of all
its columns in place of the id, so such documents draw apart; an empty table gives an empty table; extra columns pass through under any name,
and columns named copy_no or shuffle_key are replaced. Sources absent from ``weights`` have weight
0. A very long text is carried as it is, once a copy.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from larkspur.llm.common import column, free_prefix, staged, without

#: The largest mean that is drawn from one table; a larger one is the sum of parts, so the table's length is bounded.
MAX_RATE = 1000.0
#: The columns that ``replicate`` makes.
MADE = ("copy_no", "shuffle_key")
#: Copies that are exploded from one array.
RUN = 1 << 16


def hashed_uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def rates(docs: DataFrame, source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 2.0, rows: float | None = None) -> DataFrame:
    """(source, n_docs, rate) of each source.

    Without ``weights`` a source's weight is its share to the power 1 / temperature; rates are
    scaled so that about ``rows`` rows come out, by default as many as go in.
    """
    counts = docs.groupBy(column(source_col).alias("source")).agg(F.count(F.lit(1)).alias("n_docs"))
    if weights is None:
        size = F.sqrt(F.col("n_docs").cast("double")) if temperature == 2.0 else F.pow(F.col("n_docs").cast("double"), F.lit(1.0 / temperature))
    else:
        if any(w < 0 for w in weights.values()):
            raise ValueError("weights can't be negative")
        pairs = [x for k, w in weights.items() for x in (F.lit(k), F.lit(float(w)))]
        size = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0.0)) if pairs else F.lit(0.0)
    counts = staged(counts.withColumn("size", size), "mix-counts")
    total = counts.agg(F.sum("n_docs").alias("rows"), F.sum("size").alias("size"))
    target = F.col("t.rows").cast("double") if rows is None else F.lit(float(rows))
    share = F.when(F.col("t.size") > 0, F.col("c.size") / F.col("t.size")).otherwise(F.lit(0.0))
    return counts.alias("c").join(F.broadcast(total.alias("t"))).select(  # one row of totals
        "c.source", "c.n_docs", (share * target / F.col("c.n_docs")).alias("rate")
    )


def poisson_cdf(rate: Column) -> Column:
    """P(X <= k) for k = 0, 1, ... up to where nothing of a double's precision is left."""
    last = F.ceil(rate + 12.0 * F.sqrt(rate) + 24.0).cast("int")
    logs = F.aggregate(
        F.sequence(F.lit(1), last),
        F.struct((-rate).alias("p"), F.exp(-rate).alias("c"), F.array(F.exp(-rate)).alias("a")),
        lambda s, k: F.struct(
            (s["p"] + F.ln(rate) - F.ln(k.cast("double"))).alias("p"),
            (s["c"] + F.exp(s["p"] + F.ln(rate) - F.ln(k.cast("double")))).alias("c"),
            F.concat(s["a"], F.array(s["c"] + F.exp(s["p"] + F.ln(rate) - F.ln(k.cast("double"))))).alias("a"),
        ),
        lambda s: s["a"],
    )
    return F.when(rate > 0, logs).otherwise(F.array(F.lit(1.0)))


def _said(value: Column, kind: T.DataType) -> Column:
    return F.to_json(F.struct(value.alias("v"))) if isinstance(kind, T.MapType | T.ArrayType | T.StructType) else value.cast("string")


def replicate(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", weights: Mapping[str, float] | None = None, temperature: float = 2.0, seed: int = 42, rows: float | None = None) -> DataFrame:
    """Rows of ``docs`` by their Poisson count, in global random order, with copy_no and shuffle_key."""
    columns = without(docs.columns, MADE)
    p = free_prefix(*docs.columns)
    cdf, n, at = (F.col(p + x) for x in ("cdf", "n", "at"))
    parts = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("rate") / MAX_RATE))
    table = rates(docs, source_col, weights, temperature, rows).select("source", parts.alias("parts"), (F.col("rate") / parts).alias("rate"))
    table = staged(table.select(F.col("source").alias(p + "source"), F.col("parts").alias(p + "parts"), poisson_cdf(F.col("rate")).alias(p + "cdf")), "mix-rates")
    # Rows without an id would all draw alike from an empty one.
    whole = F.md5(F.concat_ws("|", *[F.coalesce(_said(column(f.name), f.dataType), F.lit("")) for f in docs.schema.fields]))
    key = F.coalesce(column(id_col).cast("string"), F.concat(F.lit("#"), whole))
    # A lambda's argument is computed once, so the hash isn't made anew for every entry of the table.
    seeded = F.lit(str(seed))
    uniforms = F.when(F.col(p + "parts") == 1, F.array(hashed_uniform(seeded, key)))
    uniforms = uniforms.otherwise(F.transform(F.sequence(F.lit(1).cast("long"), F.col(p + "parts")), lambda j: hashed_uniform(seeded, key, j.cast("string"))))
    count = F.aggregate(F.transform(uniforms, lambda v: F.size(F.filter(cdf, lambda c: c <= v))), F.lit(0), lambda total, k: total + k)
    drawn = docs.join(table, column(source_col).eqNullSafe(F.col(p + "source"))).withColumn(p + "n", count)
    copies = drawn.withColumn(p + "at", F.explode(F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(RUN)))))
    number = F.explode(F.sequence(at + 1, at + F.least(F.lit(RUN), n - at)))
    copies = copies.select(*map(column, columns), key.alias(p + "key"), number.alias("copy_no"))
    order = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(p + "key"), F.col("copy_no").cast("string"), F.lit("order")))
    copies = copies.select(*map(column, columns), "copy_no", order.alias("shuffle_key"))
    ranges = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    lead = F.conv(F.substring("shuffle_key", 1, 8), 16, 10).cast("long")
    return copies.repartitionById(ranges, F.shiftright(lead * ranges, 32).cast("int")).sortWithinPartitions("shuffle_key")


def sql(seed: int = 42) -> str:
    """The same in DuckDB SQL for temperature 2 and as many rows as go in, over the view documents."""
    return f"""
WITH RECURSIVE counts AS (SELECT source, count(*) AS n_docs, sqrt(count(*)::DOUBLE) AS size FROM documents GROUP BY source),
wanted AS (SELECT source, size / (SELECT sum(size) FROM counts) * (SELECT sum(n_docs) FROM counts)::DOUBLE / n_docs AS rate FROM counts),
rates AS (SELECT source, greatest(1, ceil(rate / {MAX_RATE}))::BIGINT AS parts, rate / greatest(1, ceil(rate / {MAX_RATE})) AS rate FROM wanted),
cdf AS (
  SELECT source, rate, 0 AS k, -rate AS p, exp(-rate) AS c FROM rates
  UNION ALL
  SELECT source, rate, k + 1, p + ln(rate) - ln((k + 1)::DOUBLE), c + exp(p + ln(rate) - ln((k + 1)::DOUBLE)) FROM cdf WHERE k < ceil(rate + 12.0 * sqrt(rate) + 24.0)
),
numbered AS (SELECT d.*, row_number() OVER () AS r FROM documents d),
asked AS (SELECT r, d.source, CASE WHEN parts = 1 THEN concat_ws('|', '{seed}', coalesce(d.doc_id::VARCHAR, '#' || md5(concat_ws('|', '', coalesce(d.text, ''), coalesce(d.lang, ''), coalesce(d.source, ''), coalesce(d.n_chars::VARCHAR, ''))))) ELSE concat_ws('|', '{seed}', coalesce(d.doc_id::VARCHAR, '#' || md5(concat_ws('|', '', coalesce(d.text, ''), coalesce(d.lang, ''), coalesce(d.source, ''), coalesce(d.n_chars::VARCHAR, '')))), j::VARCHAR) END AS said
  FROM numbered d JOIN rates ON rates.source IS NOT DISTINCT FROM d.source, unnest(range(1, parts + 1)) AS t(j)),
drawn AS (SELECT r, source, ('0x' || substr(md5(said), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0 AS u FROM asked),
counted AS (SELECT r, count(c.k) AS n FROM drawn d JOIN cdf c ON c.source IS NOT DISTINCT FROM d.source AND c.c <= d.u GROUP BY r)
SELECT doc_id, text, lang, source, n_chars, i::INTEGER AS copy_no, md5(concat_ws('|', '{seed}', coalesce(doc_id::VARCHAR, '#' || md5(concat_ws('|', '', coalesce(text, ''), coalesce(lang, ''), coalesce(source, ''), coalesce(n_chars::VARCHAR, '')))), i::VARCHAR, 'order')) AS shuffle_key
FROM counted JOIN numbered USING (r), unnest(range(1, n + 1)) AS t(i)
"""
