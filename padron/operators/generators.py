"""Statistics facts to question-answer records, one select per family."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from padron.functions.chat import chat_record
from padron.functions.hashing import SEP
from padron.functions.numbers import format_number_es, parse_number_es
from padron.functions.text import strip
from padron.lookups import (
    CATEGORY_FAMILY,
    CLAUSES,
    SAMPLE_CAP,
    SEED,
    SENTENCE_DEFAULTS,
    SENTENCES,
    ZONE_COL,
)
from padron.operators.filters import drop_missing
from padron.operators.sampling import capped_sample, shuffled
from padron.session import saved

NO_DATA = "N/D"


class Facts:
    """Column access by header, with a default for an absent or empty cell.

    Remembers which headers a template asked for, in order.
    """

    def __init__(self, columns: list[str]):
        self._names = {c.lower(): c for c in columns}
        self.used: list[str] = []

    def maybe(self, name: str) -> Column:
        """The filled cell, else null."""
        column = self._names.get(name.lower())
        if column is None:
            return F.lit(None).cast("string")
        if column not in self.used:
            self.used.append(column)
        cell = strip(F.col(f"`{column}`").cast("string"))
        return F.when(cell != "", cell)

    def get(self, name: str, default: str = NO_DATA) -> Column:
        return F.coalesce(self.maybe(name), F.lit(default))

    @property
    def total(self) -> Column:
        return F.col("_shown")


def filled(sentence: str, values: dict[str, Column]) -> Column:
    """A sentence with its names in braces replaced; null if one of them is."""
    parts = []
    for words, name, _, _ in Formatter().parse(sentence):
        parts += [F.lit(words)] if words else []
        parts += [values[name]] if name is not None else []
    return F.concat(*parts)


def told(family: str, **values: Column) -> tuple[Column, Column]:
    """Question and answer of a family; a clause without its value is a default or left out."""
    clauses = CLAUSES.get(family, {})
    whole = {
        name: F.coalesce(filled(clauses[name], {"": value}), F.lit(SENTENCE_DEFAULTS.get(name, "")))
        if name in clauses
        else value
        for name, value in values.items()
    }
    question, answer = SENTENCES[family]
    return filled(question, whole), filled(answer, whole)


Template = Callable[[Facts], tuple[Column, Column]]


def federated(f: Facts) -> tuple[Column, Column]:
    fed, place, period = f.maybe("Federación"), f.maybe("Comunidad autónoma"), f.get("periodo")
    sex = F.lower(f.maybe("Sexo"))
    return told("federated", asked=fed, named=fed, sex=sex, where=place, period=period, total=f.total)


def spend(f: Facts) -> tuple[Column, Column]:
    what = F.lower(f.get("Indicador", SENTENCE_DEFAULTS["spend"]))
    where, kind = f.maybe("Comunidad autónoma"), f.maybe("Tipo de bienes y servicios")
    return told("spend", what=what, where=where, kind=kind, when=f.get("periodo"), total=f.total)


def employment(f: Facts) -> tuple[Column, Column]:
    what, period = f.get("Indicador", SENTENCE_DEFAULTS["employment"]), f.get("periodo")
    profile = f.maybe("Sexo, grupo de edad y nivel de estudios")
    return told(
        "employment", what=what, profile_asked=profile, profile_told=profile, period=period, total=f.total
    )


def company(f: Facts) -> tuple[Column, Column]:
    what, period = f.get("Indicador", SENTENCE_DEFAULTS["company"]), f.get("periodo")
    act = f.maybe("Actividad económica")
    return told("company", what=what, activity_asked=act, activity_told=act, period=period, total=f.total)


def habits(f: Facts) -> tuple[Column, Column]:
    zone = f.get(ZONE_COL, SENTENCE_DEFAULTS["zone"])
    what = f.get("Indicador", SENTENCE_DEFAULTS["habits"])
    return told("habits", zone=zone, what=what, year=f.get("path_year"), total=f.total)


def affiliation(f: Facts) -> tuple[Column, Column]:
    kind = f.get("Tipo de indicador", SENTENCE_DEFAULTS["affiliation"])
    period, sex = f.get("Periodo"), f.maybe("Sexo")
    act = f.get("Actividad económica", "")
    return told(
        "affiliation", kind=kind, sex_asked=sex, sex_told=sex, activity=act, period=period, total=f.total
    )


def eu(f: Facts) -> tuple[Column, Column]:
    country, what = f.get("País"), f.get("Indicador", SENTENCE_DEFAULTS["eu"])
    profile, period = f.maybe("Sexo y nivel de estudios"), f.get("periodo")
    return told(
        "eu", what=what, country=country, profile_asked=profile, profile_told=profile, period=period, total=f.total
    )


FAMILIES: dict[str, Template] = {
    "federated": federated,
    "spend": spend,
    "employment": employment,
    "company": company,
    "habits": habits,
    "affiliation": affiliation,
    "eu": eu,
}


def _shown_total(facts: DataFrame) -> DataFrame:
    """Add the measure as a sentence shows it; text that is no number stays."""
    shown = F.coalesce(format_number_es(F.col("_value")), strip(F.col("Total")))
    return facts.withColumn("_value", parse_number_es(F.col("Total"))).withColumn("_shown", shown)


def _cells(facts: Facts) -> list[Column]:
    """What identifies a record: the cells its template shows."""
    return [F.col(f"`{c}`").cast("string") for c in [*facts.used, "Total"]]


def lake_pairs(
    facts: DataFrame,
    by: list[str] | None = None,
    cap: int = SAMPLE_CAP,
    seed: int = SEED,
    families: dict[str, str] | None = None,
) -> DataFrame:
    """(``by``, question, answer) of at most ``cap`` facts per source of a lake.

    ``by`` names the source unless given: ``source_path``, that is, a file or the folder that a
    writer filled with part files. Files of one name in different folders are different sources,
    part files of one folder are not. Facts without that column go by ``file_path``.

    One pass over all families. The sample is drawn on a hash of the raw cells
    first, so numbers and sentences are made for the survivors only.
    """
    if by is None:
        by = ["source_path" if "source_path" in facts.columns else "file_path"]
    routed: dict[str, list[str]] = {}
    for category, family in (families or CATEGORY_FAMILY).items():
        routed.setdefault(family, []).append(category)
    access = {name: Facts(facts.columns) for name in routed}
    texts = {name: FAMILIES[name](access[name]) for name in routed}

    def pick(choices: dict[str, Column]) -> Column:
        return F.coalesce(
            *[
                F.when(F.col("category").isin(*categories), choices[name])
                for name, categories in routed.items()
            ]
        )

    key = pick({name: F.concat_ws(SEP, *_cells(access[name])) for name in routed})
    used = list(dict.fromkeys(c for f in access.values() for c in f.used))
    rows = drop_missing(facts, "Total").filter(
        F.col("category").isin(*[c for group in routed.values() for c in group])
    )
    narrow = dict.fromkeys([*by, "category", *used, "Total"])
    keyed = rows.select(*[F.col(f"`{c}`") for c in narrow], key.alias("_key"))
    sample = _shown_total(capped_sample(keyed, list(by), ["_key"], cap, seed))
    question = pick({name: strip(texts[name][0]) for name in routed})
    answer = pick({name: strip(texts[name][1]) for name in routed})
    return sample.select(*by, question.alias("question"), answer.alias("answer"))


def qa_pairs(
    facts: DataFrame,
    family: str,
    by: list[str] | None = None,
    cap: int = SAMPLE_CAP,
    seed: int = SEED,
) -> DataFrame:
    """``lake_pairs`` for facts of one family."""
    one = facts.withColumn("category", F.lit(family))
    return lake_pairs(one, by, cap, seed, {family: family})


def union_pairs(*frames: DataFrame) -> DataFrame:
    """General pairs and generated pairs as one (origin, question, answer) table."""
    return reduce(DataFrame.unionByName, [df.select("origin", "question", "answer") for df in frames])


def training_set(pairs: DataFrame, seed: int = SEED) -> DataFrame:
    """Shuffled chat records. ``origin`` tells equal pairs of different sources apart.

    The shuffle looks at its input twice, so the pairs are saved first: the
    lake behind them is read once.
    """
    ordered = shuffled(saved(pairs, "pairs"), ["origin", "question", "answer"], seed)
    record = chat_record(F.col("question"), F.col("answer"))
    return ordered.select("position", record.alias("messages"))
