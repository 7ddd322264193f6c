"""The registered queries of the text operators and their DuckDB forms."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlake.llm import chat_format, decontamination, fill_in_middle, jaccard_join, language_id, mixing, pii, quality_rules, secret_scans, spelling, token_counts, toxicity, url_filters
from cairnlake.llm.common import table


#: The query's key, so that its results can be compared; real runs bring a secret one.
PII_KEY = os.environ.get("PII_KEY", "key-of-the-query")


#: Both turns of the conversation that op12 adds.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """The public vocabulary file; TOKENIZER_PATH names another."""
    if path := os.environ.get("TOKENIZER_PATH"):
        return path
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path())


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pseudonymise(table(spark, sf_dir, "documents"), key=PII_KEY)


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filters.url_verdicts(table(spark, sf_dir, "pages"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scans.secret_report(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture_plan(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    found = toxicity.toxicity(documents, *toxicity.train(documents, table(spark, sf_dir, "labels")))
    return found.select("doc_id", toxicity.held_out(found.doc_id).alias("held_out"), "score", (found.score >= 0.5).cast("int").alias("predicted"), "rejected")


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    held = language_id.fold(documents.doc_id, 3, held=1)
    found = language_id.language_id(documents, documents.where(~held))
    return found.select("doc_id", language_id.fold(found.doc_id, 3, held=1).alias("held_out"), "lang_pred", "score", F.array_join("langs", ",").alias("langs"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_in_middle.fill_in_middle(table(spark, sf_dir, "documents"), with_output=False)


def op12_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, i, role, CONTROL_TEXT) for i, role in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string")
    return chat_format.read_back(chat_format.format_turns(rows.unionByName(own)))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_token_counts, op3_pii, op4_url_filters, op5_secret_scans, op6_decontamination, op7_mixing, op8_toxicity, op9_language_id, op10_quality_rules, op11_fill_in_middle, op12_chat_format, op13_spelling_variants)}

_AZ = f"'{'ABCDEFGHIJKLMNOPQRSTUVWXYZ'}', '{'abcdefghijklmnopqrstuvwxyz'}'"


def _url_sql() -> str:
    hit = lambda term: f"CASE WHEN regexp_matches(low, '(^|[^0-9a-z]){term}($|[^0-9a-z])') THEN 1 ELSE 0 END"
    count = lambda terms: " + ".join(map(hit, terms))
    fits = lambda h, p: f"((host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}'))"
    longest = sorted(url_filters.RULES, key=lambda r: -len(r[0] + r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{v}'" for h, p, v in longest)
    return f"""
WITH split AS (
  SELECT page_id, translate(coalesce(url, ''), {_AZ}) AS low,
         translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 1), {_AZ}) AS host,
         regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)([^?#]*)', 2) AS path
  FROM pages
), counted AS (
  SELECT *, CAST({count(url_filters.STRICT)} AS BIGINT) AS n_strict, CAST({count(url_filters.SOFT)} AS BIGINT) AS n_soft FROM split
)
SELECT page_id, host, path, CASE {rule} END AS rule,
       CASE {verdict} WHEN n_strict > 0 OR n_soft >= {url_filters.SOFT_LIMIT} THEN 'block' ELSE 'allow' END AS verdict,
       n_strict, n_soft
FROM counted"""


_MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), per_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, CAST(source_size * {mixing.CAP} AS BIGINT) AS most,
         CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % {len(mixing.WEIGHTS)} {" ".join(f"WHEN {i} THEN {w}" for i, w in enumerate(mixing.WEIGHTS))} END AS DOUBLE) AS w
  FROM per_source
), filled AS (
  SELECT *, CAST(CAST(sum(source_size) OVER () - coalesce(sum(most) OVER below, 0) AS BIGINT) AS DOUBLE) / (sum(w) OVER () - coalesce(sum(w) OVER below, 0)) AS level
  FROM weighed
  WINDOW below AS (ORDER BY CAST(most AS DOUBLE) / w, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), goal AS (
  SELECT source, source_size, least(CAST(most AS DOUBLE), w * max(level) OVER ()) AS target FROM filled
), drawn AS (
  SELECT doc_id, size, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         CAST(CAST('0x' || substr(md5('{mixing.SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u
  FROM sized JOIN goal ON sized.source IS NOT DISTINCT FROM goal.source
), taken AS (
  SELECT *, CAST(floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END AS BIGINT) AS copies FROM drawn
)
SELECT doc_id, size, source_size, target, copies, CAST(size * copies AS BIGINT) AS taken FROM taken"""

_HIT_SQL = f"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), item AS (
  SELECT row_number() OVER () AS b, coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), win AS (
  SELECT b, item, i, len AS n, array_to_string(w[i : i + len - 1], ' ') AS s
  FROM (SELECT b, item, w, least(len(w), 13) AS len, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM item WHERE len(w) > 0)
), lens AS (SELECT DISTINCT n FROM win
), found AS (
  SELECT d.r, d.i, d.n, win.item, win.b, win.i AS j
  FROM (SELECT r, n, i, array_to_string(w[i : i + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM doc, lens WHERE len(w) >= n)) d
  JOIN win ON win.n = d.n AND win.s = d.s
), hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r
), named AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS said FROM (SELECT DISTINCT r, item FROM found) GROUP BY r
), islands AS (
  SELECT r, n, i - row_number() OVER (PARTITION BY r, b, i - j ORDER BY i) AS g, b, i - j AS diagonal FROM found
), longest AS (
  SELECT r, max(words) AS n_longest FROM (SELECT r, max(n) + count(*) - 1 AS words FROM islands GROUP BY r, b, diagonal, g) GROUP BY r
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(said, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, CAST(coalesce(n_longest, 0) AS BIGINT) AS n_longest
FROM doc LEFT JOIN hit USING (r) LEFT JOIN named USING (r) LEFT JOIN longest USING (r)"""

_WORD_SQL = "'[^\\x20\\x09-\\x0D]+'"
_LINES_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {_WORD_SQL}) AS w, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
lines AS (SELECT r, doc_id, source, l[i] AS line, regexp_extract_all(l[i], {_WORD_SQL}) AS lw FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM d)),
filled AS (SELECT *, len(lw) AS n, translate(array_to_string(lw, ' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789', 'abcdefghijklmnopqrstuvwxyz000000000') AS k FROM lines WHERE len(lw) > 0),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup FROM filled GROUP BY r),
win AS (SELECT r, i, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT r, w, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5)),
rep AS (SELECT r, count(DISTINCT p) AS n_rep FROM (SELECT r, unnest(range(i, i + 5)) AS p FROM (SELECT r, i, count(*) OVER (PARTITION BY r, s) AS c FROM win) WHERE c > 1) GROUP BY r),
common AS (SELECT source, k FROM (SELECT DISTINCT source, coalesce('=' || doc_id, '#' || r) AS doc, k FROM filled) GROUP BY source, k HAVING count(*) > 20),
lost AS (SELECT r, sum(n) AS lost FROM filled JOIN common ON filled.source IS NOT DISTINCT FROM common.source AND filled.k = common.k GROUP BY r),
m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(coalesce(n_dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(n_rep, 0) AS BIGINT) AS n_repeat_words, CAST(len(w) - coalesce(lost, 0) AS BIGINT) AS n_words_left
  FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r) LEFT JOIN lost USING (r)
)
SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND n_words_left >= 0.3::DOUBLE * n_words AS kept FROM m"""

_FIM_SQL = """
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')) AS ends, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents
), counted AS (
  SELECT *, ends + CASE WHEN t = '' OR ends_with(t, chr(10)) THEN 0 ELSE 1 END AS n, string_split(t, chr(10)) AS l FROM d
), drawn AS (
  SELECT doc_id, t, n, ends, l, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS x, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS y,
         CASE WHEN t = '' OR regexp_matches(t, '<[PSM]>') THEN 'plain' WHEN CAST('0x' || h[25:32] AS BIGINT) % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM counted
), cut AS (
  SELECT doc_id, t, n, form, length(array_to_string(l[1 : least(x, y)], chr(10))) + CASE WHEN least(x, y) BETWEEN 1 AND ends THEN 1 ELSE 0 END AS p,
         length(array_to_string(l[1 : greatest(x, y)], chr(10))) + CASE WHEN greatest(x, y) BETWEEN 1 AND ends THEN 1 ELSE 0 END AS q
  FROM drawn
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(p AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(q - p AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'psm' THEN '<P>' || left(t, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p)
                        WHEN 'spm' THEN '<S>' || substr(t, q + 1) || '<P>' || left(t, p) || '<M>' || substr(t, p + 1, q - p) ELSE t END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM cut"""

_MARKERS = "SYS\\]|/SYS\\]|INST\\]|/INST\\]|ROLE\\]|/ROLE\\]|TEXT\\]"
_CHAT_SQL = f"""
WITH rows_of AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, i, role, '{CONTROL_TEXT}' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, role)
), placed AS (
  SELECT *, row_number() OVER w - 1 AS place, lag(role) OVER w AS before,
         length(text) + len(regexp_extract_all(text, '(\\[\\\\*({_MARKERS})|<\\\\*(s>|/s>))')) AS chars,
         length(role) + len(regexp_extract_all(role, '(\\[\\\\*({_MARKERS})|<\\\\*(s>|/s>))')) AS role_chars
  FROM rows_of WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), judged AS (
  SELECT *, CASE role WHEN 'system' THEN place = 0 WHEN 'user' THEN place = 0 OR before IN ('system', 'assistant') WHEN 'assistant' THEN place > 0 AND before = 'user' ELSE false END AS good FROM placed
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars + CASE role WHEN 'system' THEN 11 WHEN 'user' THEN 13 WHEN 'assistant' THEN 7 ELSE 19 + role_chars END) AS BIGINT) AS formatted_chars,
       bool_and(good) AS valid, CAST(min(place) FILTER (NOT good) AS BIGINT) AS first_bad, arg_max(role, place) = 'assistant' AS complete
FROM judged GROUP BY conv_id"""

ORACLE_SQL = {"op11_fill_in_middle": _FIM_SQL, "op12_chat_format": _CHAT_SQL, "op10_quality_rules": _LINES_SQL, "op4_url_filters": _url_sql(), "op6_decontamination": _HIT_SQL, "op7_mixing": _MIX_SQL}
