"""Registered queries of this subpackage: one thin call of each operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from metaloom.llm import collocations, decontamination, ego_join, jaccard_join, language_id, periodic_runs, pii_tagger, piece_sampling, sharding, token_counts, toxicity, url_filter, warc_archive

#: (host, path, verdict) as the query's contract fixes them
URL_RULES = [
    ("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode_documents(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_documents(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


def op5_pii_tagger(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_tagger.find_documents(table(spark, sf_dir, "documents"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_pages(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, "host string, path string, verdict string"))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"), shards=8)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_ego_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ego_join.near_duplicates(table(spark, sf_dir, "embeddings"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.summarise_runs(table(spark, sf_dir, "documents"), plant=True)


def op13_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.archive_pages(table(spark, sf_dir, "pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_piece_sampling": op1_piece_sampling,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_decontamination": op3_decontamination,
    "op4_token_counts": op4_token_counts,
    "op5_pii_tagger": op5_pii_tagger,
    "op6_language_id": op6_language_id,
    "op7_url_filter": op7_url_filter,
    "op8_sharding": op8_sharding,
    "op9_toxicity": op9_toxicity,
    "op10_ego_join": op10_ego_join,
    "op11_collocations": op11_collocations,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_warc_archive": op13_warc_archive,
}

_RULES_SQL = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)

ORACLES: dict[str, str] = {
    "op7_url_filter": f"""
WITH rules(rh, rp, rv) AS (VALUES {_RULES_SQL}),
parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, row_number() OVER () AS row
  FROM pages
),
best AS (
  SELECT row, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS verdict
  FROM parts JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY row
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM parts LEFT JOIN best USING (row)
""",
    "op11_collocations": r"""
WITH pieces AS (
  SELECT doc_id, row, coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM (SELECT *, row_number() OVER () AS row FROM documents)
),
numbered AS (SELECT lang, row_number() OVER () AS p, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM pieces),
flat AS (SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM numbered),
following AS (
  SELECT lang, w, lead(w, 1) OVER pos AS w2, lead(w, 2) OVER pos AS w3, lead(w, 3) OVER pos AS w4, lead(w, 4) OVER pos AS w5
  FROM flat WINDOW pos AS (PARTITION BY p ORDER BY i)
),
grams AS (
  SELECT lang, [w] AS ws FROM following
  UNION ALL SELECT lang, [w, w2] FROM following WHERE w2 IS NOT NULL
  UNION ALL SELECT lang, [w, w2, w3] FROM following WHERE w3 IS NOT NULL
  UNION ALL SELECT lang, [w, w2, w3, w4] FROM following WHERE w4 IS NOT NULL
  UNION ALL SELECT lang, [w, w2, w3, w4, w5] FROM following WHERE w5 IS NOT NULL
),
f AS (SELECT lang, ws, count(*) AS a FROM grams GROUP BY lang, ws HAVING count(*) >= 100),
total AS (SELECT lang, count(*) AS n FROM flat GROUP BY lang),
cuts AS (SELECT lang, ws, a, unnest(range(1, len(ws))) AS k FROM f WHERE len(ws) >= 2),
scored AS (
  SELECT c.lang, c.ws, c.a, n, k, x.a AS l, y.a AS r, ((1000::HUGEINT * c.a * n) // (x.a::HUGEINT * y.a))::BIGINT AS score
  FROM cuts c JOIN f x ON x.lang = c.lang AND x.ws = list_slice(c.ws, 1, k) JOIN f y ON y.lang = c.lang AND y.ws = list_slice(c.ws, k + 1, len(c.ws)) JOIN total t ON t.lang = c.lang
),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, ws ORDER BY score, k) AS o FROM scored) WHERE o = 1),
wide AS (SELECT lang, ws, a, unnest(range(2, len(ws))) AS size FROM f WHERE len(ws) >= 3),
inside AS (
  SELECT lang, list_slice(ws, b, b + size - 1) AS ws, max(a) AS longer
  FROM (SELECT lang, ws, a, size, unnest(range(1, len(ws) - size + 2)) AS b FROM wide) GROUP BY ALL
),
kept AS (
  SELECT b.lang, array_to_string(b.ws, ' ') AS phrase, a, l, r, n, score FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.ws = b.ws
  WHERE longer IS NULL OR 100 * longer < 100 * a
),
ranked AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM kept)
SELECT * FROM ranked WHERE rank <= 2000
""",
}
