"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

Words are runs of characters other than ASCII white space. The counts are array expressions
over one row, so nothing is shuffled and a long document costs n log n in its words.

Defined results: a null or empty text has no word, fails the base rule and is not kept;
repeated rows and ties get equal results; an empty table gives an empty table; other columns
pass through ``apply_rules`` under any name, and it replaces columns of the names it makes. A very
long text is measured whole.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkspur.llm.common import column, free_prefix, without

SPACE = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
#: Frequent function words of the four corpus languages (fixed values).
STOP_WORDS = (
    "the of and to in that is was for it with as on be at by this are or an from "
    "le la les de des du et un une est en que qui dans pour sur pas au avec ce il elle "
    "der die das und ist in von zu den mit im für nicht ein eine auf dem sich als auch es "
    "el los las y una con por para se lo como más su al no del"
).split()


@dataclass(frozen=True)
class Rule:
    """``metric`` must lie in [low, high]; None leaves a side open."""

    metric: str
    low: float | None = None
    high: float | None = None


#: The production thresholds. Ratios of an empty text are null and fail no rule of their own.
RULES = (
    Rule("n_words", low=50, high=100_000),
    Rule("mean_word_chars", low=2.0, high=16.0),
    Rule("symbol_word_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
    Rule("alpha_word_ratio", low=0.7),
    Rule("shout_word_ratio", high=0.3),
)

_RATIOS = ("mean_word_chars", "symbol_word_ratio", "stop_word_ratio", "alpha_word_ratio", "shout_word_ratio", "dup_line_ratio", "bullet_line_ratio", "ellipsis_line_ratio")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: The columns that ``apply_rules`` makes.
MADE = (*COUNTS, *_RATIOS, "base_failed", "failed_rules", "kept")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a.cast("double") / b)


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the five counts and the ratios that rules may name."""
    names = without(docs.columns, (*COUNTS, *_RATIOS))
    columns, p = [column(c) for c in names], free_prefix(*docs.columns)
    out = docs.select(*columns, F.coalesce(column(text_col).cast("string"), F.lit("")).alias(p + "t"))
    out = out.withColumn(p + "w", F.array_remove(F.split(p + "t", "[ \\t-\\r]+"), ""))
    out = out.withColumn(p + "n", F.size(p + "w"))
    windows = F.transform(
        F.slice(p + "w", F.lit(1), F.greatest(F.col(p + "n") - 2, F.lit(0))),
        lambda w, i: F.concat_ws(" ", w, F.get(p + "w", i + 1), F.get(p + "w", i + 2)),
    )
    lines = F.filter(F.split(p + "t", "\n"), lambda x: F.length(F.translate(x, SPACE, "")) > 0)
    letters = F.lit("[\\p{L}]")
    out = out.select(
        *columns,
        F.length(F.translate(p + "t", SPACE, "")).cast("long").alias("word_chars"),
        (F.length(p + "t") - F.length(F.translate(p + "t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.col(p + "n").cast("long").alias("n_words"),
        windows.alias(p + "g"),
        lines.alias(p + "l"),
        F.size(F.filter(p + "w", lambda w: F.rtrim(F.lower(w), F.lit(".,;:!?")).isin(sorted(set(STOP_WORDS))))).alias(p + "stop"),
        F.size(F.filter(p + "w", lambda w: F.rlike(w, letters))).alias(p + "alpha"),
        F.size(F.filter(p + "w", lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1))).alias(p + "shout"),
    )
    # Windows in sorted order stand beside their equals; only texts with a repeat are sorted.
    repeats = F.size(F.array_distinct(p + "g")) < F.size(p + "g")
    out = out.withColumn(p + "s", F.when(repeats, F.sort_array(F.transform(p + "g", lambda g, i: F.struct(g.alias("g"), i.alias("i"))))))
    hit = F.transform(p + "s", lambda s, k: F.when((F.get(p + "s", k - 1)["g"] == s["g"]) | (F.get(p + "s", k + 1)["g"] == s["g"]), s["i"]))
    out = out.withColumn(p + "p", F.sort_array(F.array_compact(hit)))
    # A repeated window covers up to the next one's start, three words at most.
    cover = F.aggregate(
        F.transform(p + "p", lambda x, k: F.least(F.lit(3), F.coalesce(F.get(p + "p", k + 1) - x, F.lit(3)))), F.lit(0), lambda a, x: a + x
    )
    n_lines = F.size(p + "l")
    # One row from an array of one struct: a filter on the verdict stays above it, where otherwise it
    # would be pushed through every projection and repeat the array expressions many times over.
    counts = F.struct(
        "n_words", "word_chars", "n_symbols", p + "stop", p + "alpha", p + "shout",
        (n_lines - F.size(F.array_distinct(p + "l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(cover, F.lit(0)).cast("long").alias("n_repeat_words"),
        n_lines.alias(p + "nl"),
        F.size(F.filter(p + "l", lambda x: F.rlike(x, F.lit("^[ \\t]*([-*\u2022]|[0-9]+[.)])[ \\t]")))).alias(p + "bullet"),
        F.size(F.filter(p + "l", lambda x: F.rlike(x, F.lit("(\\.\\.\\.|\u2026)[ \\t\\r]*$")))).alias(p + "dots"),
    )
    out = out.select(*columns, F.inline(F.array(counts)))
    n = F.col("n_words")
    return out.select(
        *columns, *COUNTS,
        _ratio(F.col("word_chars"), n).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), n).alias("symbol_word_ratio"),
        _ratio(F.col(p + "stop"), n).alias("stop_word_ratio"),
        _ratio(F.col(p + "alpha"), n).alias("alpha_word_ratio"),
        _ratio(F.col(p + "shout"), n).alias("shout_word_ratio"),
        _ratio(F.col("n_dup_lines"), F.col(p + "nl")).alias("dup_line_ratio"),
        _ratio(F.col(p + "bullet"), F.col(p + "nl")).alias("bullet_line_ratio"),
        _ratio(F.col(p + "dots"), F.col(p + "nl")).alias("ellipsis_line_ratio"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def compiled(rules: tuple[Rule, ...] = RULES) -> list[Column]:
    """One boolean column per rule, true where the rule fails."""
    out = []
    for rule in rules:
        value, fails = F.col(rule.metric), F.lit(False)
        if rule.low is not None:
            fails = fails | (value < F.lit(rule.low))
        if rule.high is not None:
            fails = fails | (value > F.lit(rule.high))
        out.append(F.coalesce(fails, F.lit(False)).alias(rule.metric))
    return out


def apply_rules(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text") -> DataFrame:
    """``docs`` with counts, ratios, base_failed, failed_rules and kept."""
    kept = without(docs.columns, ("base_failed", "failed_rules", "kept"))
    made = measure(docs.select(*map(column, dict.fromkeys((*kept, text_col)))), text_col)
    made = made.select(*[column(c) for c in made.columns if c in kept or c in COUNTS or c in _RATIOS])
    names = F.array(*[F.when(x, F.lit(r.metric)) for r, x in zip(rules, compiled(rules), strict=True)])
    out = made.withColumns({"base_failed": base_failed(), "failed_rules": F.array_compact(names)})
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
