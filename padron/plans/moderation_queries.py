"""Labelled texts, lexical rules, scores, and their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from padron.functions.numbers import round_even
from padron.functions.scores import over_threshold, softmax_positive
from padron.functions.text import fold_long, fold_text
from padron.lookups import BLOCKED_TERMS, TOXIC_THRESHOLD
from padron.operators import epochs, labels, metrics, model, moderation, sampling, term_index
from padron.plans.record_queries import TRIM
from padron.plans.registry import register, table
from padron.session import saved

# The blocklist and words that the table's labelled texts use.
TERMS = (*BLOCKED_TERMS, "idiot", "moron", "worthless", "clown")


def labelled(spark, sf):
    texts = table(spark, sf, "documents").select("doc_id", "text")
    return labels.labelled_text(texts, table(spark, sf, "labels"), "doc_id", "toxic")


@register(
    "labelled_text",
    "SELECT doc_id, text, toxic AS label FROM documents JOIN labels USING (doc_id)",
)
def labelled_text(spark, sf):
    return labelled(spark, sf)


@register(
    "union_labelled",
    f"SELECT {TRIM.format('text')} AS text, toxic AS label FROM documents JOIN labels USING"
    f" (doc_id) UNION ALL SELECT {TRIM.format('text')}, 0 FROM benchmark",
)
def union_labelled(spark, sf):
    """Clean list, toxic list and a list of edge cases."""
    rows = labelled(spark, sf)
    return labels.labelled_union(
        (rows.filter("label = 0"), 0),
        (rows.filter("label = 1"), 1),
        (table(spark, sf, "benchmark").withColumn("label", F.lit(0)), None),
    )


@register(
    "class_balance",
    "SELECT toxic AS label, count(*) AS n, (SELECT count(*) FROM labels) AS total,"
    " printf('%.1f', count(*) / (SELECT count(*) FROM labels) * 100.0) AS pct"
    " FROM labels GROUP BY toxic",
)
def class_balance(spark, sf):
    rows = table(spark, sf, "labels").select(F.col("toxic").alias("label"))
    return labels.class_balance(rows)


_FOLDED = "strip_accents(lower(text))"
_ANY = "|".join(fold_text(t) for t in TERMS)
SUBSTRING_SQL = f"regexp_matches({_FOLDED}, '{_ANY}')"
WORD_SQL = f"regexp_matches({_FOLDED}, '(^|[^\\p{{L}}\\p{{N}}])({_ANY})($|[^\\p{{L}}\\p{{N}}])')"
HITS_SQL = (
    "array_to_string(list_filter(["
    + ", ".join(f"'{fold_text(t)}'" for t in TERMS)
    + f"], lambda t: contains({_FOLDED}, t)), ',')"
)


def folded_texts(spark, sf):
    return table(spark, sf, "documents").select("doc_id", fold_long(F.col("text")).alias("folded"))


@register(
    "toxic_lexical",
    f"SELECT doc_id, {SUBSTRING_SQL} AS substring, {WORD_SQL} AS word, {HITS_SQL} AS hits"
    " FROM documents",
)
def toxic_lexical(spark, sf):
    found = moderation.flags_and_hits(folded_texts(spark, sf), "folded", TERMS)
    return found.select("doc_id", "substring", "word", F.array_join("hits", ",").alias("hits"))


#: Words 4 to 6 of each text: a list as long as the table.
_NORMAL = "regexp_replace(strip_accents(lower({})), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')"
LONG_LIST_SQL = f"""
WITH texts AS (SELECT doc_id, ' ' || {_NORMAL.format('text')} || ' ' AS body FROM documents),
listed AS (SELECT doc_id AS place, trim(array_to_string(string_split_regex(trim({_NORMAL.format('text')}),
    ' ')[4:6], ' ')) AS term FROM documents),
terms AS (SELECT term, min(place) AS place FROM listed WHERE term <> '' GROUP BY term)"""


def long_list(spark, sf):
    """(term, place): three words of each text, the first place of each.

    Places are written first: filters on terms would be pushed down and fold the texts once more.
    """
    listed = folded_texts(spark, sf).select(term_index.words_from(F.col("folded"), 4, 3).alias("term"), "doc_id")
    first = saved(listed.groupBy("term").agg(F.min("doc_id").alias("place")), "first-places")
    return term_index.term_list(first.where("term <> ''"), "term", keep=["place"])


def normal_texts(spark, sf):
    return folded_texts(spark, sf).select("doc_id", term_index.plain_text(F.col("folded")).alias("body"))


@register(
    "long_term_list",
    f"""{LONG_LIST_SQL} SELECT doc_id, count(*) AS hits, min(place) AS first_place
FROM texts JOIN terms ON contains(body, ' ' || term || ' ') GROUP BY doc_id""",
)
def long_term_list(spark, sf):
    """Hits of a list of one term per document, through an index on runs of words."""
    terms = long_list(spark, sf)
    hits = term_index.listed_hits(normal_texts(spark, sf), "doc_id", "body", terms, keep=["place"])
    return hits.groupBy("doc_id").agg(F.count(F.lit(1)).alias("hits"), F.min("place").alias("first_place"))


@register(
    "long_alias_list",
    f"""{LONG_LIST_SQL} SELECT doc_id, min_by(term, place) AS alias, 'Z' || min(place) AS official
FROM texts JOIN terms ON contains(body, ' ' || term || ' ') GROUP BY doc_id""",
)
def long_alias_list(spark, sf):
    """The first of many aliases that a text names, with its official name."""
    aliases = long_list(spark, sf).withColumn(
        "official", F.concat(F.lit("Z"), F.col("place").cast("string"))
    )
    found = term_index.first_listed(normal_texts(spark, sf), "doc_id", "body", aliases)
    return found.withColumnRenamed("term", "alias")


@register(
    "moderated",
    f"""SELECT doc_id, CASE WHEN {WORD_SQL} THEN 'lexical' WHEN score >= {TOXIC_THRESHOLD}
  THEN 'score' END AS blocked_by FROM (SELECT *, doc_id % 10 / 10.0 AS score FROM documents)""",
)
def moderated(spark, sf):
    """Blocklist first, then a given score."""
    docs = table(spark, sf, "documents").select(
        "doc_id", "text", (F.col("doc_id") % 10 / F.lit(10.0)).alias("score")
    )
    return moderation.moderated(docs, score="score", terms=TERMS).select("doc_id", "blocked_by")


def predicted(spark, sf):
    """Only texts with a label are folded and searched, where the labels are few enough to send."""
    truth = table(spark, sf, "labels").select("doc_id", F.col("toxic").alias("label"))
    texts = labels.only_labelled(table(spark, sf, "documents").select("doc_id", "text"), truth, "doc_id")
    folded = texts.select("doc_id", fold_long(F.col("text")).alias("folded"))
    flag = moderation.lexical_flag(F.col("folded"), TERMS, "word").cast("int")
    return folded.select("doc_id", flag.alias("pred")).join(truth, "doc_id").select("label", "pred")


PREDICTED_SQL = (
    f"predicted AS (SELECT toxic AS label, CAST({WORD_SQL} AS INTEGER) AS pred"
    " FROM documents JOIN labels USING (doc_id))"
)
MATRIX_SQL = (
    f"WITH {PREDICTED_SQL}, matrix AS (SELECT"
    " count(*) FILTER (pred = 1 AND label = 1) AS tp, count(*) FILTER (pred = 1 AND label = 0)"
    " AS fp, count(*) FILTER (pred = 0 AND label = 1) AS fn,"
    " count(*) FILTER (pred = 0 AND label = 0) AS tn FROM predicted)"
)


@register("confusion_matrix", f"{MATRIX_SQL} SELECT * FROM matrix")
def confusion_matrix(spark, sf):
    return metrics.confusion_matrix(predicted(spark, sf))


def _r4(value: str) -> str:
    return f"CAST(printf('%.4f', {value}) AS DOUBLE)"


@register(
    "binary_metrics",
    f"{MATRIX_SQL} SELECT tp, fp, fn, tn, {_r4('(tp + tn) / (tp + tn + fp + fn)')} AS accuracy,"
    f" {_r4('p')} AS precision, {_r4('r')} AS recall, {_r4('coalesce(2 * p * r / (p + r), 0)')}"
    " AS f1 FROM (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS p,"
    " coalesce(tp / nullif(tp + fn, 0), 0) AS r FROM matrix)",
)
def binary_metrics(spark, sf):
    return metrics.binary_metrics(metrics.confusion_matrix(predicted(spark, sf)))


@register(
    "class_report",
    f"""WITH {PREDICTED_SQL},
classes AS (SELECT DISTINCT label AS cls FROM predicted UNION SELECT DISTINCT pred FROM predicted),
counts AS (SELECT cls, count(*) FILTER (label = cls) AS support, count(*) FILTER (pred = cls)
  AS chosen, count(*) FILTER (pred = cls AND label = cls) AS hit FROM classes, predicted
  GROUP BY cls),
rates AS (SELECT *, coalesce(hit / nullif(chosen, 0), 0) AS p,
  coalesce(hit / nullif(support, 0), 0) AS r FROM counts),
full_rates AS (SELECT *, coalesce(2 * p * r / nullif(p + r, 0), 0) AS f FROM rates)
SELECT CAST(cls AS VARCHAR) AS class, {_r4('p')} AS precision, {_r4('r')} AS recall, {_r4('f')}
  AS f1, support FROM full_rates
UNION ALL SELECT 'accuracy', {_r4('sum(hit) / sum(support)')}, {_r4('sum(hit) / sum(support)')},
  {_r4('sum(hit) / sum(support)')}, sum(support) FROM full_rates
UNION ALL SELECT 'macro avg', {_r4('avg(p)')}, {_r4('avg(r)')}, {_r4('avg(f)')}, sum(support)
  FROM full_rates
UNION ALL SELECT 'weighted avg', {_r4('sum(p * support) / sum(support)')},
  {_r4('sum(r * support) / sum(support)')}, {_r4('sum(f * support) / sum(support)')}, sum(support)
  FROM full_rates""",
)
def class_report(spark, sf):
    return metrics.class_report(predicted(spark, sf))


@register(
    "toxic_threshold",
    f"""SELECT doc_id, CAST(printf('%.6f', s) AS DOUBLE) AS score, s >= {TOXIC_THRESHOLD} AS toxic
FROM (SELECT doc_id, 1.0 / (1.0 + exp(1.0 - 2.0 * len(list_filter([
  {', '.join(f"'{fold_text(t)}'" for t in TERMS)}], lambda t: contains({_FOLDED}, t))))) AS s
  FROM documents)""",
)
def toxic_threshold(spark, sf):
    """Two logits per text: a constant, and two per term found."""
    hits = F.size(moderation.lexical_hits(F.col("folded"), TERMS, "substring"))
    score = softmax_positive(F.lit(1.0), hits * F.lit(2.0))
    scored = folded_texts(spark, sf).select("doc_id", score.alias("score"))
    return scored.select(
        "doc_id",
        round_even(F.col("score"), 6).alias("score"),
        over_threshold(F.col("score")).alias("toxic"),
    )


@register("toxic_classifier")
def toxic_classifier(spark, sf):
    """Train on four fifths of the labelled texts, score all of them."""
    rows = sampling.with_split(labelled(spark, sf), ["doc_id"], test_share=0.2)
    fitted = model.train(rows.filter("split = 'train'"), terms=TERMS)
    scored = model.score(fitted, rows, terms=TERMS)
    flag = over_threshold(F.col("score"), TOXIC_THRESHOLD).alias("toxic")
    return scored.select("doc_id", "split", "label", "score", flag)


@register("toxic_model_select")
def toxic_model_select(spark, sf):
    """Held-out quality after 5 to 80 passes of one solver, the best marked."""
    rows = sampling.with_split(labelled(spark, sf), ["doc_id"], test_share=0.2)
    train, test = (rows.filter(F.col("split") == side) for side in ("train", "test"))
    _, report = epochs.select_best(train, test, terms=TERMS)
    return report
