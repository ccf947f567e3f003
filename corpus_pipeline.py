"""From raw documents to token ids: language, quality, near-duplicates, mixing, BPE.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept; ``run``
stores every stage's rows in the shared folder before the next one reads them.

Defined results of a stage, besides those of its operator: the columns of ``docs`` come out as they
are, under any name, in the first four stages; a null or empty text has no language and is dropped
by the first; rows without an id or with the same id are judged by their own text; an empty table
gives an empty table; a very long text is worked on whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, lang_id, mix, rules, simhash
from larkspur.llm.common import column, free_prefix, staged


def _aside(docs: DataFrame, made: Sequence[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns named as those that an operator makes called otherwise, and the columns that bring the names back."""
    gone, p = {m.lower() for m in made}, free_prefix(*docs.columns)
    names = {c: p + str(i) if c.lower() in gone else c for i, c in enumerate(docs.columns)}
    return docs.select(*[column(c).alias(n) for c, n in names.items()]), [column(n).alias(c) for c, n in names.items()]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts without a letter and those whose nearest language is ambiguous."""
    model = lang_id.learn(docs, F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1, F.lit(False)))
    rows, back = _aside(docs, lang_id.MADE)
    told = lang_id.identify(rows, model)
    return told.where((F.col("lang_pred") != lang_id.UND) & ~F.col("ambiguous")).select(*back)


def apply_quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that fail the base rule or a threshold."""
    rows, back = _aside(docs, rules.MADE)
    return rules.apply_rules(rows).where("kept").select(*back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each SimHash component."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents by their source's Poisson counts, in global random order."""
    rows, back = _aside(docs, mix.MADE)
    return mix.replicate(rows).select(*back)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, with the digests of ids and decoded text."""
    return bpe.round_trip(docs, with_ids=True).select("doc_id", "lang", "source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language ID", identify_language),
    ("quality rules", apply_quality_rules),
    ("SimHash near-dedup", drop_near_duplicates),
    ("source mixing", mix_sources),
    ("BPE", encode_tokens),
]

#: Learned language codes and the BPE merges have no SQL; tests hold the rows against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        out = staged(stage(spark, out, sf_dir), "pipeline-" + name.split()[0].lower())
    return STAGES[-1][1](spark, out, sf_dir)
