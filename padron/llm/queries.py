"""The operators' queries over the given tables, each next to its SQL where one exists."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from padron.llm import (
    bag_search,
    bpe,
    chat_format,
    decontamination,
    jaccard_join,
    licenses,
    line_dedup,
    lm,
    lsh_forest,
    ns_bounds,
    quality_classifier,
    quality_rules,
    secrets,
)

QUERIES = {}
SQL: dict[str, str] = {}

#: The public vocabulary file that the encoder's queries use.
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


#: White space and A-Z as the contracts have them, for DuckDB.
_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_LINES = "string_split(coalesce(text, ''), chr(10))"

LINE_SQL = f"""
WITH docs AS (SELECT doc_id, {_LINES} AS lines FROM documents),
places AS (
  SELECT doc_id, unnest(range(len(lines))) AS place, unnest(lines) AS line FROM docs),
keyed AS (
  SELECT *, translate(trim(line, {_WS}), '{line_dedup.UPPER}', '{line_dedup.LOWER}') AS key
  FROM places),
common AS (
  SELECT key, max(doc_id) AS keeper FROM keyed WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
flagged AS (
  SELECT k.doc_id, k.place, k.line, c.key IS NOT NULL AND k.doc_id <> c.keeper AS dropped
  FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT dropped), ''))
    AS kept_sha256
FROM flagged GROUP BY doc_id
"""


@query("op1_line_dedup", LINE_SQL)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_report(table(spark, sf_dir, "documents"))


@query("op2_quality_rules")
def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.report(table(spark, sf_dir, "documents"))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return jaccard_join.near_copies(docs, words=4, percent=85)


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return decontamination.matches(docs, benchmark)


@query("op5_secret_scan")
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(table(spark, sf_dir, "documents"))


@query("op6_chat_formatting")
def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.report(table(spark, sf_dir, "conversations"))


@query("op7_quality_classifier")
def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_classifier.report(table(spark, sf_dir, "documents"))


@query("op8_bpe")
def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Most time goes into words that a worker meets anew, so it remembers many.
    return bpe.token_digest(table(spark, sf_dir, "documents"), WORD_BPE, words=500_000)


@query("op9_license_scan")
def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(table(spark, sf_dir, "documents"))


@query("op10_lm_scoring")
def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.report(table(spark, sf_dir, "documents"))


#: The terms of a whole text, for DuckDB.
_TERMS = (
    r"regexp_extract_all(coalesce(text, ''), '[^\x{0}-\x{2F}\x{3A}-\x{40}\x{5B}-\x{60}\x{7B}-\x{7F}]+')"
)

SEARCH_SQL = f"""
WITH docs AS MATERIALIZED (
  SELECT row_number() OVER () AS row, doc_id,
    list_transform({_TERMS}, lambda t: translate(t, '{line_dedup.UPPER}', '{line_dedup.LOWER}')) AS terms
  FROM documents),
total AS (
  SELECT count(*) FILTER (WHERE len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM docs),
held AS MATERIALIZED (
  SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM docs) GROUP BY row, term),
spread AS (SELECT term, count(*) AS df FROM held GROUP BY term),
wanted AS (
  SELECT DISTINCT item_id, unnest(list_transform({_TERMS},
    lambda t: translate(t, '{line_dedup.UPPER}', '{line_dedup.LOWER}'))) AS term
  FROM benchmark),
weighted AS (
  SELECT item_id, term, floor(1000 * ln((2.0::DOUBLE * n + 2) / (2.0::DOUBLE * df + 1)))::BIGINT AS w
  FROM wanted JOIN spread USING (term), total),
scored AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m)))::BIGINT AS score
  FROM weighted JOIN held USING (term)
  JOIN (SELECT row, 100 - 90 + (90 * len(terms) * n) // l AS m FROM docs, total) USING (row)
  GROUP BY item_id, row),
ranked AS (
  SELECT item_id, doc_id, score,
    row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank
  FROM scored JOIN docs USING (row) WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= {bag_search.BEST}
"""


@query("op11_lexical_search", SEARCH_SQL)
def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, t) for t in ("documents", "benchmark"))
    return bag_search.ranked(docs, benchmark)


@query("op12_minhash_forest")
def op12_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lsh_forest.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def _cluster_sql(rounds: int = ns_bounds.ROUNDS, k: int = ns_bounds.CENTROIDS) -> str:
    """Every round as two tables: the nearest centroid of each vector, the floors of the means."""
    parts = [
        f"""vectors AS MATERIALIZED (
  SELECT row_number() OVER () AS row, vec_id,
    list_transform(embedding, lambda x: floor({ns_bounds.SCALE} * x::DOUBLE)::BIGINT) AS x
  FROM embeddings
  WHERE len(embedding) = {ns_bounds.DIMS}
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {ns_bounds.DIMS})""",
        f"""c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id) NULLS LAST, x) - 1 AS c, x AS m FROM vectors
  QUALIFY c < {k})""",
    ]
    for at in range(rounds + 1):
        parts.append(
            f"""a{at} AS MATERIALIZED (
  SELECT row, min(struct_pack(d := list_sum(list_transform(range(1, {ns_bounds.DIMS + 1}),
    lambda i: (x[i] - m[i]) * (x[i] - m[i])))::BIGINT, c := c)) AS best
  FROM vectors, c{at} GROUP BY row)"""
        )
        if at < rounds:
            parts.append(
                f"""m{at} AS MATERIALIZED (
  SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m
  FROM (SELECT best.c AS c, i, sum(x[i])::BIGINT AS s, count(*) AS n
    FROM a{at} JOIN vectors USING (row), range(1, {ns_bounds.DIMS + 1}) p(i) GROUP BY best.c, i)
  GROUP BY c),
c{at + 1} AS MATERIALIZED (
  SELECT c, coalesce(m{at}.m, c{at}.m) AS m FROM c{at} LEFT JOIN m{at} USING (c))"""
            )
    return f"""WITH {", ".join(parts)}
SELECT vec_id, best.c::INTEGER AS cluster, best.d AS distance,
  sum(best.d) OVER (PARTITION BY best.c)::BIGINT AS cluster_inertia,
  sum(best.d) OVER ()::BIGINT AS inertia,
  sha256(array_to_string(m, ',')) AS centroid_sha256
FROM a{rounds} JOIN vectors USING (row) JOIN c{rounds} ON c{rounds}.c = best.c
"""


@query("op13_ns_bounds", _cluster_sql())
def op13_ns_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ns_bounds.clustered(table(spark, sf_dir, "embeddings"))
