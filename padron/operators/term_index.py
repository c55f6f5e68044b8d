"""Lists of many terms, found through an index instead of a search per term.

A term that stands between word limits in a text has its words in that text, whole and in a row.
So each term is filed under its words, a longer one under its rarest run of ``RUN`` words. Texts are
looked through once for runs of words that are in that index (``term_runs``), in the task that reads
them; a text of words with one space between then holds each term that is its own run, and only other
terms and texts are looked at by pattern. A text has at most ``RUN`` times as many runs as words, so
cost follows the words of the texts and the terms that they hold, not texts times terms: a list that
grows with the texts, all of common words, names no more terms than there are places in the texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.text import fold
from padron.operators import term_runs
from padron.session import saved

_LETTER = r"\p{L}\p{N}"
#: Most words of a run.
RUN = 3
#: Most terms that are sent to the runs of the texts; of more, both are dealt out by run.
MAX_SENT_RUNS = 1 << 21


def plain_words(folded: Column) -> Column:
    """Runs of letters and digits of a folded text."""
    parts = F.split(folded, rf"[^{_LETTER}]+")
    return F.filter(parts, lambda w: w != "")


def plain_text(folded: Column) -> Column:
    """``plain_words`` with a space between, without an array of them."""
    return F.btrim(F.regexp_replace(folded, rf"[^{_LETTER}]+", " "))


def is_plain(folded: Column) -> Column:
    """Words with a space between and nothing else: it is its own ``plain_text``, and not empty."""
    return folded.rlike(rf"^(?:[{_LETTER}]++ )*+[{_LETTER}]++\z")


def words_from(folded: Column, first: int, n: int) -> Column:
    """``n`` words from the ``first`` (at 1) with a space between, fewer at the end; reads on no further."""
    before = rf"^[^{_LETTER}]*+(?:[{_LETTER}]++[^{_LETTER}]++){{{first - 1}}}+"
    found = F.regexp_extract(folded, rf"{before}((?:[{_LETTER}]++[^{_LETTER}]*+){{1,{n}}}+)", 1)
    return plain_text(found)


def runs_of(term: Column) -> Column:
    """The words of a term, or all its runs of ``RUN`` words if they are more."""
    words = F.split(plain_text(term), " ")
    many = F.transform(F.sequence(F.lit(1), F.size(words) - (RUN - 1)), lambda at: F.array_join(F.slice(words, at, RUN), " "))
    return F.when(F.size(words) <= RUN, F.array(plain_text(term))).otherwise(many)


def own_run(term: Column) -> Column:
    """The term is the only run of itself: a plain text that holds the run holds the term."""
    return F.array_contains(runs_of(term), term)


def stands_in(folded: Column, term: Column) -> Column:
    """The term occurs between word limits."""
    quoted = F.concat(F.lit(rf"(?<![{_LETTER}])\Q"), term, F.lit(rf"\E(?![{_LETTER}])"))
    return F.contains(folded, term) & F.rlike(folded, quoted)


def term_list(df: DataFrame, term: str, *, keep: list[str] = ()) -> DataFrame:
    """(term, keep...): folded, once each, without blank ones. A term needs a letter or digit."""
    folded = df.select(fold(F.btrim(F.col(term))).alias("term"), *keep)
    return folded.where(plain_text(F.col("term")) != "").distinct()


def filed(terms: DataFrame, text_words: DataFrame, parts: Column | None = None) -> DataFrame:
    """(word, term): each term under that of its ``parts`` that the fewest texts hold.

    ``parts``: an array made of the column ``term``; without it, the plain words. ``text_words``: (id, word),
    each once. A term with a part that no text holds is left out: it occurs nowhere.
    """
    parts = plain_words(F.col("term")) if parts is None else parts
    each = terms.select("term").distinct().select("term", F.explode(F.array_distinct(parts)).alias("word"))
    asked = each.select("word").distinct()
    spread = text_words.join(asked, "word", "left_semi").groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word")).alias("best")
    least = each.join(spread, "word", "left").groupBy("term").agg(rarest)
    return least.where("best.n > 0").select("best.word", "term")


def _index(terms: DataFrame, held: DataFrame, keep: list[str]) -> DataFrame:
    """(word, other, keep...): the run that each term is filed under; ``other`` is the term if it is not its own run."""
    runs = runs_of(F.col("term"))
    index = terms.where(F.size(runs) == 1).withColumn("word", F.get(runs, F.lit(0)))
    more = terms.where(F.size(runs) > 1)
    if not more.isEmpty():
        rarest = filed(more, held.select(F.explode("runs").alias("word")), runs)
        index = index.unionByName(more.join(rarest, "term"))
    return index.select("word", F.when(~own_run(F.col("term")), F.col("term")).alias("other"), *keep)


def named_terms(rows: DataFrame, terms: DataFrame, *, keep: list[str] = ()) -> DataFrame:
    """(columns of ``rows`` but ``body``, term, keep..., sure): the terms to look for in each row, each once.

    ``body`` is a plain text; in it, terms that are ``sure`` are found and need no look. ``terms`` (term, keep...):
    a table, since it is read several times, its rows once each.
    """
    terms = terms.select("term", *keep).where(plain_text(F.col("term")) != "")
    each = terms.select(F.explode(runs_of(F.col("term"))).alias("word"))
    sizes = each.select(F.size(F.split("word", " ")).alias("n")).distinct().collect()  # at most RUN
    bits = term_runs.asked_map(each, "word")
    held = saved(term_runs.held_runs(rows, bits, sorted(r["n"] for r in sizes)), "held-runs")
    index = saved(_index(terms, held, list(keep)), "term-index")
    if index.count() <= MAX_SENT_RUNS:
        index = F.broadcast(index)
    named = held.withColumn("word", F.explode("runs")).join(index, "word")
    own = [c for c in rows.columns if c != "body"]
    return named.select(*own, F.coalesce("other", "word").alias("term"), *keep, F.isnull("other").alias("sure"))


def _looked_at(rows: DataFrame, named: DataFrame, keep: list[str]) -> DataFrame:
    """(key, term, keep...): those of ``named`` that stand in the text; ``rows`` (id, key, text) have each text once."""
    looks = named.groupBy("id").agg(F.collect_set(F.struct("term", *keep)).alias("looks"))
    both = rows.where("text IS NOT NULL").select("id", "key", "text").join(looks, "id")
    return both.select("key", F.inline(F.filter("looks", lambda t: stands_in(F.col("text"), t["term"]))))


def listed_hits(texts: DataFrame, key: str, folded: str, terms: DataFrame, *, keep: list[str] = ()) -> DataFrame:
    """(key, term, keep...) for each term that stands in a text between word limits.

    ``terms``: ``term_list``, with ``keep`` of its columns. Rows of one key are one text for the result. Null texts
    hold nothing. Texts that are not plain, or all if a term is not its own run, are looked at by pattern.
    """
    listed = saved(terms.select("term", *keep).distinct(), "listed")
    looked = not listed.where(~own_run(F.col("term"))).isEmpty()
    rows = texts.select(F.col(key).alias("key"), F.col(folded).alias("text"))
    rows = rows.select("key", "text", is_plain(F.col("text")).alias("plain"))
    body = F.when(F.col("plain"), F.col("text")).otherwise(plain_text(F.col("text")))
    carried = F.when(F.lit(looked) | ~F.col("plain"), F.col("text"))
    rows = rows.select("key", "plain", body.alias("body"), carried.alias("text"))
    known = F.col("sure") & F.col("plain")
    if listed.count() <= MAX_SENT_RUNS:
        named = named_terms(rows, listed, keep=keep)
        hits = named.where(known | stands_in(F.col("text"), F.col("term"))).select("key", "term", *keep)
    else:  # runs are dealt out, so texts stay behind
        rows = saved(rows.withColumn("id", F.monotonically_increasing_id()), "folded")
        named = named_terms(rows.drop("text"), listed, keep=keep)
        hits = named.where(known).select("key", "term", *keep)
        if not rows.where("text IS NOT NULL").isEmpty():
            hits = hits.unionByName(_looked_at(rows, named.where(~known), keep))
    # A row has each term once, so only rows of the same key can repeat one.
    once = texts.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    return (hits if once else hits.distinct()).withColumnRenamed("key", key)


def first_listed(texts: DataFrame, key: str, folded: str, aliases: DataFrame) -> DataFrame:
    """(key, term, official): the alias of the smallest ``place`` that stands in each text.

    ``aliases``: (term, official, place), terms as in ``term_list``. Hits carry the rank of their alias, since the
    smallest number of each key is found without sorting them.
    """
    order = aliases.select("place", "term", "official").orderBy("place", "term", "official")
    ranked = saved(order.withColumn("rank", F.monotonically_increasing_id()), "ranked")
    hits = listed_hits(texts, key, folded, ranked, keep=["rank"])
    best = hits.groupBy(key).agg(F.min("rank").alias("rank"))
    return best.join(ranked, "rank").select(key, "term", "official")
