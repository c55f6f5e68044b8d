"""Text, number and period expressions over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from padron.functions import chat, numbers, periods, text
from padron.operators import columns, filters
from padron.plans.facts import es_any
from padron.plans.registry import register, table

CELL_WS = "chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || ' '"
TOKENS = r"string_split_regex(trim(text, " + CELL_WS + r"), '\s+')"


@register(
    "text_normalize",
    "SELECT doc_id, strip_accents(lower(text)) AS folded FROM documents",
)
def text_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.fold_long(F.col("text")).alias("folded"))


PHRASES = ("idiot", "más", "été", "über")


@register(
    "contains_any",
    "SELECT doc_id, "
    + " OR ".join(f"contains(f, '{p}')" for p in ("idiot", "mas", "ete", "uber"))
    + " AS hit FROM (SELECT doc_id, strip_accents(lower(text)) AS f FROM documents)",
)
def contains_any(spark, sf):
    docs = table(spark, sf, "documents").withColumn("folded", text.fold_long(F.col("text")))
    return docs.select("doc_id", text.contains_any(F.col("folded"), PHRASES).alias("hit"))


@register("contains_filter", "SELECT doc_id, source FROM documents WHERE contains(text, 'idiot')")
def contains_filter(spark, sf):
    docs = table(spark, sf, "documents")
    return filters.containing(docs, "text", "idiot").select("doc_id", "source")


@register(
    "clean_strings",
    f"SELECT doc_id, trim(replace(text, chr(65279), ''), {CELL_WS}) AS text, lang, source, n_chars"
    " FROM documents",
)
def clean_strings(spark, sf):
    docs = table(spark, sf, "documents")
    noisy = docs.withColumn(
        "text", F.concat(F.lit("﻿"), F.col("text"), F.lit(" \t"))
    ).withColumnRenamed("lang", " ﻿lang ")
    return columns.clean_strings(noisy)


@register(
    "ws_rejoin",
    f"SELECT doc_id, array_to_string({TOKENS}, ' ') || ' ' AS text FROM documents"
    f" WHERE trim(text, {CELL_WS}) <> '' UNION ALL"
    f" SELECT doc_id, '' FROM documents WHERE trim(text, {CELL_WS}) = ''",
)
def ws_rejoin(spark, sf):
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.ws_rejoin(F.col("text")).alias("text"))


@register(
    "length_budget",
    f"SELECT doc_id, len(t) <= {chat.CHAT_MAX_TOKENS} AS fits,"
    f" array_to_string(t[1:{chat.CHAT_MAX_TOKENS}], ' ') AS cut"
    f" FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
)
def length_budget(spark, sf):
    """A budget flag and the text cut to the budget, which is what the operator is for."""
    docs = table(spark, sf, "documents")
    return docs.select(
        "doc_id",
        chat.within_budget(F.col("text")).alias("fits"),
        F.array_join(chat.truncate_words(F.col("text")), " ").alias("cut"),
    )


@register(
    "pad_truncate",
    "SELECT doc_id, array_to_string(list_resize(t[1:128], 128, '<pad>'), ' ') AS tokens,"
    " repeat('1', least(len(t), 128)) || repeat('0', 128 - least(len(t), 128)) AS mask"
    f" FROM (SELECT doc_id, {TOKENS} AS t FROM documents)",
)
def pad_truncate(spark, sf):
    padded = table(spark, sf, "documents").select(
        "doc_id", chat.pad_truncate(F.col("text")).alias("p")
    )
    return padded.select(
        "doc_id",
        F.array_join("p.tokens", " ").alias("tokens"),
        F.array_join(F.col("p.attention_mask").cast("array<string>"), "").alias("mask"),
    )


@register("mojibake_repair", f"SELECT doc_id, trim(text, {CELL_WS}) AS text FROM documents")
def mojibake_repair(spark, sf):
    """Damage every text by reading its UTF-8 as Latin-1, then repair it."""
    damaged = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    docs = table(spark, sf, "documents")
    return docs.select("doc_id", text.repair_mojibake(damaged).alias("text"))


@register(
    "number_parse_es",
    "SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS price,"
    " CAST(l_quantity AS DOUBLE) AS quantity FROM lineitem",
)
def number_parse_es(spark, sf):
    """Prices written the Spanish way and read back."""
    price = numbers.format_number_es(F.col("l_extendedprice"))
    quantity = F.concat(F.lit("\xa0"), numbers.format_number_es(F.col("l_quantity")), F.lit(" "))
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber",
        numbers.parse_number_es(price).alias("price"),
        numbers.parse_number_es(quantity).alias("quantity"),
    )


@register("number_format_es", f"SELECT o_orderkey, {es_any('o_totalprice')} AS total FROM orders")
def number_format_es(spark, sf):
    return table(spark, sf, "orders").select(
        "o_orderkey", numbers.format_number_es(F.col("o_totalprice")).alias("total")
    )


@register(
    "kpi_format",
    "SELECT o_orderkey, '€ ' || printf('%.0f', o_totalprice) AS spend,"
    " CASE WHEN o_totalprice > 1e5 THEN printf('%.1f', o_totalprice / 1e6) || 'M'"
    " ELSE format('{:,.0f}', o_totalprice) END AS licences FROM orders",
)
def kpi_format(spark, sf):
    price = F.col("o_totalprice")
    return table(spark, sf, "orders").select(
        "o_orderkey",
        numbers.kpi_spend(price).alias("spend"),
        numbers.kpi_licences(price).alias("licences"),
    )


@register(
    "year_cast",
    "SELECT periodo, year(o_orderdate) AS anio, count(*) AS n FROM (SELECT o_orderdate,"
    " ' ' || CAST(year(o_orderdate) AS VARCHAR) || '.0' AS periodo FROM orders"
    " WHERE o_orderstatus <> 'P') GROUP BY ALL UNION ALL"
    " SELECT 'N/D', NULL, count(*) FROM orders WHERE o_orderstatus = 'P' HAVING count(*) > 0",
)
def year_cast(spark, sf):
    """Years as text; open orders carry text that is no year."""
    label = F.concat(F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(".0"))
    labelled = table(spark, sf, "orders").select(
        F.when(F.col("o_orderstatus") == "P", F.lit("N/D")).otherwise(label).alias("periodo")
    )
    return (
        labelled.withColumn("anio", periods.year_cast(F.col("periodo")))
        .groupBy("periodo", "anio")
        .agg(F.count(F.lit(1)).alias("n"))
    )


@register(
    "period_parse",
    "SELECT strftime(ts, '%Y. Mes %m') AS label, strftime(date_trunc('month', ts), '%Y-%m-%d')"
    " AS month, event_type, count(*) AS n FROM events GROUP BY ALL",
)
def period_parse(spark, sf):
    label = F.date_format("ts", "yyyy'. Mes 'MM").alias("label")
    counts = table(spark, sf, "events").groupBy(label, "event_type").agg(
        F.count(F.lit(1)).alias("n")
    )
    month = periods.month_label(F.col("label")).cast("string")
    return counts.select("label", month.alias("month"), "event_type", "n")


@register(
    "path_category",
    "SELECT page_id, coalesce(nullif(split_part(lower(p), '/', 3), ''), '') AS category FROM"
    " (SELECT page_id, 'data/raw/' || regexp_replace(url, '^https?://', '') || '/f.csv' AS p"
    " FROM pages)",
)
def path_category(spark, sf):
    """Page addresses laid out as lake paths: the site is the category folder."""
    path = F.concat(
        F.lit("data/RAW/"), F.regexp_replace("url", "^https?://", ""), F.lit("/f.csv")
    )
    return table(spark, sf, "pages").select(
        "page_id", periods.path_category(path).alias("category")
    )


@register(
    "path_year",
    "SELECT page_id, coalesce(nullif(regexp_extract(url, '(20[0-9]{2})', 1), ''), 'N/D') AS anio"
    " FROM pages",
)
def path_year(spark, sf):
    return table(spark, sf, "pages").select("page_id", periods.path_year(F.col("url")).alias("anio"))


@register(
    "coalesce_columns",
    "SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority ELSE o_orderstatus END"
    " AS comunidad, CAST(year(o_orderdate) AS VARCHAR) AS periodo FROM orders",
)
def coalesce_columns(spark, sf):
    """Two damaged header spellings of one dimension; the first filled cell counts."""
    raw = table(spark, sf, "orders").select(
        "o_orderkey",
        F.nullif("o_orderstatus", F.lit("P")).alias("Comunidad autÃ³noma"),
        F.col("o_orderpriority").alias("ï»¿Comunidad autonoma"),
        F.year("o_orderdate").cast("string").alias("Periodo"),
    )
    named = columns.coalesce_columns(
        raw,
        {"comunidad": ["Comunidad autónoma"], "periodo": ["periodo"], "absent": ["no such header"]},
    )
    return named.select("o_orderkey", "comunidad", "periodo")


@register(
    "drop_null_measure",
    "SELECT event_id, event_type FROM events WHERE event_type NOT IN ('error', 'view')",
)
def drop_null_measure(spark, sf):
    """Errors have no measure and views the ``..`` mark; both go."""
    total = F.when(F.col("event_type") == "view", F.lit("..")).when(
        F.col("event_type") != "error", F.col("value").cast("string")
    )
    events = table(spark, sf, "events").select("event_id", "event_type", total.alias("Total"))
    return filters.drop_missing(events).drop("Total")


@register(
    "exclude_set",
    "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS estado, o_orderpriority FROM orders"
    " WHERE (o_orderstatus <> 'F')"
    " AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH')",
)
def exclude_set(spark, sf):
    """Set exclusion and null-safe inequality: rows with a null stay."""
    orders = table(spark, sf, "orders").select(
        "o_orderkey", F.nullif("o_orderstatus", F.lit("P")).alias("estado"), "o_orderpriority"
    )
    return orders.filter(filters.differs(F.col("estado"), "F")).filter(
        filters.not_in(F.col("o_orderpriority"), ("1-URGENT", "2-HIGH"))
    )
