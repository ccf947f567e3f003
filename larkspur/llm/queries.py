"""The registered queries of the corpus operators, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.llm import bpe, chat, collocations, jaccard, lang_id, media, mix, quality, rules, search, simhash, token_store, warc
from larkspur.llm.common import new_path


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _fold(column: str, n: int) -> Column:
    """crc32 of an id as text, modulo n."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % n


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = lang_id.learn(docs, _fold("doc_id", 3) != 1)
    held_out = F.coalesce(_fold("doc_id", 3) == 1, F.lit(False)).alias("held_out")
    return lang_id.identify(docs.select("doc_id", "text", held_out), model).select("doc_id", "held_out", "lang_pred", "score", "ambiguous")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(_read(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(told).alias("text"))
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(more)
    out = chat.read_back(chat.format_chats(rows))
    line = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.col("n_blocks").cast("long").alias("n_blocks"),
    )


OP3_SQL = """
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
told AS (
  SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS opens, row_number() OVER w AS i FROM rows
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
),
%s
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  (sum(length(etext)) + sum(opens * (length(erole) + 16 + CASE WHEN i > 1 THEN 7 ELSE 0 END) + (1 - opens) * 8) + 7)::BIGINT AS formatted_chars,
  sum(opens)::BIGINT AS n_blocks
FROM escaped GROUP BY conv_id
"""


def _sql_escape(column: str) -> str:
    out = f"replace({column}, '~', '~0')"
    for said, code in chat.CONTROL:
        out = f"replace({out}, '{said}', '~{code}')"
    return out


OP3_SQL = OP3_SQL % f"escaped AS (SELECT *, {_sql_escape('text')} AS etext, {_sql_escape('role')} AS erole FROM told)"


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = rules.apply_rules(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return made.select("doc_id", *rules.COUNTS, "base_failed", "kept")


def _op4_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in sorted(set(rules.STOP_WORDS)))
    fails = []
    for r in rules.RULES:
        fails += [f"coalesce({r.metric} < {r.low}, false)"] * (r.low is not None) + [f"coalesce({r.metric} > {r.high}, false)"] * (r.high is not None)
    space = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS r FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
  list_filter(string_split(t, chr(10)), lambda x: length(translate(x, {space}, '')) > 0) AS l FROM t),
g AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
p AS (SELECT r, sum(c)::BIGINT AS n_repeat_words FROM (SELECT r, least(3, coalesce(lead(i) OVER (PARTITION BY r ORDER BY i) - i, 3)) AS c FROM h) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(translate(t, {space}, ''))::BIGINT AS word_chars,
    (length(t) - length(translate(t, '{rules.SYMBOLS}', '')))::BIGINT AS n_symbols,
    (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
    len(list_filter(w, lambda x: rtrim(lower(x), '.,;:!?') IN ({stops}))) AS stop, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS alpha,
    len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x AND length(x) > 1)) AS shout, len(l) AS nl,
    len(list_filter(l, lambda x: regexp_matches(x, '^[ \\t]*([-*\u2022]|[0-9]+[.)])[ \\t]'))) AS bullet,
    len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|\u2026)[ \\t\\r]*$'))) AS dots
  FROM w LEFT JOIN p USING (r)
),
q AS (
  SELECT *, word_chars::DOUBLE / nullif(n_words, 0) AS mean_word_chars, n_symbols::DOUBLE / nullif(n_words, 0) AS symbol_word_ratio,
    stop::DOUBLE / nullif(n_words, 0) AS stop_word_ratio, alpha::DOUBLE / nullif(n_words, 0) AS alpha_word_ratio, shout::DOUBLE / nullif(n_words, 0) AS shout_word_ratio,
    n_dup_lines::DOUBLE / nullif(nl, 0) AS dup_line_ratio, bullet::DOUBLE / nullif(nl, 0) AS bullet_line_ratio, dots::DOUBLE / nullif(nl, 0) AS ellipsis_line_ratio,
    (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT ({" OR ".join(fails)}) AS kept FROM q
"""


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "warc")
    warc.write(_read(spark, sf_dir, "pages"), folder)
    return warc.read(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


# Base32 of 20 bytes: each 5 hex digits are 20 bits, 4 characters.
OP5_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS sha FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY sha, payload_bytes) AS first FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 8), lambda g: array_to_string(list_transform(range(0, 4), lambda c:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(sha, 5 * g::INTEGER + 1, 5))::INTEGER >> (15 - 5 * c::INTEGER)) & 31) + 1, 1)), '')), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM f
"""


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix.replicate(_read(spark, sf_dir, "documents"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_read(spark, sf_dir, "documents"))


def op8_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "labels").select("doc_id", "quality")
    scorer = quality.learn(docs, labels, _fold("id", 4) != 2)
    held_out = F.coalesce(_fold("doc_id", 4) == 2, F.lit(False)).alias("held_out")
    return quality.score(docs.select("doc_id", "text", held_out), scorer).select("doc_id", "held_out", "score", "predicted")


def op9_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media.media_columns(_read(spark, sf_dir, "documents"))
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_frames", "frames")


def op10_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_path(spark, "tokens")
    token_store.write(_read(spark, sf_dir, "documents"), folder)
    return token_store.read_documents(spark, folder)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_read(spark, sf_dir, "documents").select("lang", "text"))


OP11_SQL = """
WITH t AS (SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\\x0A-\\x0D]')) AS p FROM t),
w AS (SELECT lang, regexp_extract_all(p, '[^\\x20\\x09]+') AS w FROM p),
f AS (SELECT lang, g, m, count(*) AS f FROM (SELECT lang, m, unnest(list_transform(range(1, len(w) - m + 2), lambda i: array_to_string(w[i:i + m - 1], ' '))) AS g FROM w, (SELECT unnest([1, 2, 3, 4]) AS m) WHERE len(w) >= m) GROUP BY lang, g, m),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE m = 1 GROUP BY lang),
c AS (SELECT lang, g, m, f, string_split(g, ' ') AS w FROM f WHERE m > 1 AND f >= 30),
around AS (SELECT lang, g, max(f) AS around FROM (SELECT c.lang, c.f, unnest(flatten(list_transform(range(2, m), lambda k: list_transform(range(1, m - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))))) AS g FROM c WHERE m > 2) GROUP BY lang, g),
kept AS (SELECT c.* FROM c LEFT JOIN around USING (lang, g) WHERE around IS NULL OR 100 * around < 80 * f),
cut AS (SELECT lang, g, m, f, k, array_to_string(w[1:k], ' ') AS x, array_to_string(w[k + 1:m], ' ') AS y FROM (SELECT *, unnest(range(1, m)) AS k FROM kept)),
s AS (SELECT cut.*, a.f AS l, b.f AS r, ((2000000::HUGEINT * cut.f) // (a.f + b.f))::BIGINT AS score FROM cut JOIN f a ON a.lang = cut.lang AND a.g = x JOIN f b ON b.lang = cut.lang AND b.g = y),
least AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
top AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, f DESC, g)::INTEGER AS rank, g AS phrase, f AS a, l, r, score FROM least)
SELECT lang, rank, phrase, a, l, r, n, score FROM top JOIN n USING (lang) WHERE rank <= 2000
"""


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


_TERMS = "regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS t FROM documents),
i AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
s AS (SELECT count(*) AS n_docs, sum(len(t))::BIGINT AS length FROM d WHERE len(t) > 0),
p AS (SELECT r, doc_id, term, count(*) AS tf, any_value(n) AS n FROM (SELECT r, doc_id, len(t) AS n, unnest(t) AS term FROM d) GROUP BY r, doc_id, term),
w AS (SELECT term, floor(1000 * ln((2 * any_value(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, s GROUP BY term),
g AS (
  SELECT item_id, r, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + ((50 * n * n_docs) // length)))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), s GROUP BY item_id, r, doc_id
)
SELECT item_id, rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST, r)::INTEGER AS rank FROM g WHERE score > 0) WHERE rank <= 50
"""

def op13_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": op1_language_id,
    "op2_bpe": op2_bpe,
    "op3_chat_format": op3_chat_format,
    "op4_quality_rules": op4_quality_rules,
    "op5_warc": op5_warc,
    "op6_source_mix": op6_source_mix,
    "op7_simhash": op7_simhash,
    "op8_quality_pu": op8_quality_pu,
    "op9_gif_media": op9_gif_media,
    "op10_token_store": op10_token_store,
    "op11_collocations": op11_collocations,
    "op12_search": op12_search,
    "op13_jaccard": op13_jaccard,
}

ORACLE_SQL = {"op3_chat_format": OP3_SQL, "op4_quality_rules": _op4_sql(), "op5_warc": OP5_SQL, "op6_source_mix": mix.sql(), "op11_collocations": OP11_SQL, "op12_search": OP12_SQL}
