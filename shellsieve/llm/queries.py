"""The registered queries of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shellsieve.llm.decontaminate import contamination
from shellsieve.llm.exact import exact_duplicates
from shellsieve.llm.htmltext import extract_text
from shellsieve.llm.langid import identify_languages
from shellsieve.llm.lm import lm_scores
from shellsieve.llm.mix import mix
from shellsieve.llm.passages import without_repeated_passages
from shellsieve.llm.periods import periodic_runs, with_planted_runs
from shellsieve.llm.search import best_documents
from shellsieve.llm.simhash import near_duplicates
from shellsieve.llm.tokencount import token_counts
from shellsieve.llm.tokens import token_files
from shellsieve.llm.urls import url_verdicts

#: Host, start of the path and verdict.
URL_RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    """The tokenizer of the token files, at the same path on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def vocabulary_path() -> str:
    """The vocabulary of the token counts, at the same path on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def url_rules(spark: SparkSession) -> DataFrame:
    rules = (
        F.struct(F.lit(h).alias("host"), F.lit(p).alias("path"), F.lit(v).alias("verdict"))
        for h, p, v in URL_RULES
    )
    return spark.range(1).select(F.inline(F.array(*rules)))


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files(table(spark, sf_dir, "documents"), tokenizer_path())


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op6_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), vocabulary_path())


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_verdicts(table(spark, sf_dir, "pages"), url_rules(spark))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken"
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    run = "named_struct('less', -r.length, 'start', r.start, 'period', r.period)"
    return found.withColumn("best", F.expr(f"array_min(transform(runs, r -> {run}))")).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        (-F.col("best.less")).alias("length"),
        F.col("best.period").alias("period"),
        F.expr("(-1000 * best.less) div best.period").alias("exponent_milli"),
        F.expr(
            "sha2(array_join(transform(runs, r -> concat(concat_ws(',', r.start, r.length, r.period),"
            " '\n')), ''), 256)"
        ).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeated_passages(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_files, op2_decontamination, op3_language_id, op4_html_text, op5_simhash,
        op6_lm_scores, op7_token_counts, op8_url_filter, op9_mixing, op10_exact_dedup,
        op11_periodic_runs, op12_lexical_search, op13_substring_dedup,
    )
}

_FOLD = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_FOLD.format('text')}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_WORDS = rf"regexp_extract_all({_FOLD.format('text')}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op2_decontamination": rf"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_WORDS} AS words FROM documents),
items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, {_WORDS} AS words FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(words[i + 1 : i + n], ' ') AS gram
  FROM (SELECT item, words, least(len(words), 10) AS n,
               unnest(range(len(words) - least(len(words), 10) + 1)) AS i
        FROM items WHERE len(words) > 0)),
places AS (
  SELECT row, n, i, array_to_string(words[i + 1 : i + n], ' ') AS gram
  FROM (SELECT row, words, n, unnest(range(len(words) - n + 1)) AS i
        FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(words) >= n)),
hits AS (SELECT row, n, i, item FROM places JOIN windows USING (n, gram)),
hit_words AS (
  SELECT row, count(DISTINCT place) AS n_hit
  FROM (SELECT row, unnest(range(i, i + n)) AS place FROM (SELECT DISTINCT row, n, i FROM hits))
  GROUP BY row),
hit_items AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
       coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       n_hit IS NOT NULL AS contaminated
FROM docs LEFT JOIN hit_words USING (row) LEFT JOIN hit_items USING (row)
""",
    "op6_lm_scores": rf"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all({_FOLD.format('text')}, '[^\x20\x09-\x0D]+') AS words FROM documents),
tokens AS (
  SELECT row, i, words[i] AS word
  FROM (SELECT row, words, unnest(range(1, len(words) + 1)) AS i FROM docs)),
pairs AS (
  SELECT row, i, word, lag(word) OVER text AS before, i > 1 AS follows FROM tokens
  WINDOW text AS (PARTITION BY row ORDER BY i)),
words AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
followed AS (SELECT before, count(*) AS n FROM pairs WHERE follows GROUP BY before),
counted AS (SELECT before, word, count(*) AS n FROM pairs WHERE follows GROUP BY before, word),
logs AS (
  SELECT p.row, CASE WHEN follows
           THEN round(ln(c.n) * 1000000) - round(ln(f.n) * 1000000)
           ELSE round(ln(w.n) * 1000000) - round(ln((SELECT count(*) FROM tokens)) * 1000000) END AS score
  FROM pairs p JOIN words w ON p.word IS NOT DISTINCT FROM w.word
  LEFT JOIN followed f ON follows AND p.before IS NOT DISTINCT FROM f.before
  LEFT JOIN counted c ON follows AND p.before IS NOT DISTINCT FROM c.before
                         AND p.word IS NOT DISTINCT FROM c.word)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(coalesce(score, 0) AS BIGINT) AS score_micros
FROM docs LEFT JOIN (SELECT row, sum(score) AS score FROM logs GROUP BY row) USING (row)
""",
    "op8_url_filter": """
WITH parted AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3)
                       ELSE '' END AS rest FROM pages),
urls AS (
  SELECT page_id,
         translate(regexp_extract(rest, '^[^/?#]*', 0),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM parted),
rules(rule_host, rule_path, verdict) AS (VALUES """
    + ", ".join(str(rule) for rule in URL_RULES)
    + """),
fits AS (
  SELECT DISTINCT host, path, rule_host || rule_path AS rule, verdict FROM urls, rules
  WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)),
best AS (
  SELECT host, path, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM fits GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN best USING (host, path)
""",
    "op10_exact_dedup": f"""
WITH docs AS (SELECT doc_id, sha256({_FOLD.format('text')}) AS text_sha256,
                     {_FOLD.format('text')} AS folded FROM documents)
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = max(doc_id) OVER same AS kept, text_sha256
FROM docs WINDOW same AS (PARTITION BY folded)
""",
    "op12_lexical_search": f"""
WITH docs AS (SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents),
totals AS (
  SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS n_docs,
         CAST(sum(len(terms)) AS BIGINT) AS n_terms FROM docs),
items AS (SELECT row_number() OVER () AS item, item_id, list_distinct({_TERMS}) AS terms FROM benchmark),
asked AS (SELECT item, unnest(terms) AS term FROM items),
entries AS (
  SELECT row, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*) AS tf
  FROM (SELECT row, doc_id, CAST(len(terms) AS BIGINT) AS n, unnest(terms) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY row, term),
weights AS (
  SELECT term, CAST(floor(1000 * ln((2 * any_value(n_docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM entries, totals GROUP BY term),
scored AS (
  SELECT item, row, any_value(doc_id) AS doc_id,
         CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM entries JOIN weights USING (term) JOIN asked USING (term), totals GROUP BY item, row),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id NULLS LAST) AS rank
  FROM scored WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM ranked JOIN items USING (item)
WHERE rank <= 10
""",
    "op13_substring_dedup": r"""
WITH docs AS (
  SELECT row_number() OVER () AS row, doc_id,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
windows AS (
  SELECT row, doc_id, i, array_to_string(words[i : i + 12], ' ') AS gram
  FROM (SELECT row, doc_id, words, unnest(range(1, len(words) - 11)) AS i FROM docs WHERE len(words) > 12)),
hits AS (
  SELECT row, i FROM windows
  JOIN (SELECT gram, min(doc_id) AS least FROM windows GROUP BY gram HAVING count(*) > 1) USING (gram)
  WHERE least < doc_id),
removed AS (SELECT DISTINCT row, unnest(range(i, i + 13)) AS place FROM hits),
kept AS (
  SELECT row, string_agg(word, ' ' ORDER BY place) AS kept, count(*) AS n
  FROM (SELECT row, unnest(range(1, len(words) + 1)) AS place, unnest(words) AS word FROM docs)
  ANTI JOIN removed USING (row, place) GROUP BY row)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words,
       CAST(len(words) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (row)
""",
}
