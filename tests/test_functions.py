"""Golden values of the column functions."""

import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from padron.functions import chat, hashing, numbers, periods, scores, text


def apply(spark, build, values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", build(F.col("v")).alias("out")).orderBy("i").collect()]


@pytest.mark.parametrize("build", [text.fold, text.fold_long])
def test_fold(spark, build):
    values = ["Andalucía", "ÑANDÚ Çé", "Andalucía", "İzmir", "ASCII only", "straße ø", None, ""]
    assert apply(spark, build, values) == [
        "andalucia", "nandu ce", "andalucia", "izmir", "ascii only", "straße ø", None, "",
    ]


def test_fold_equals_decomposition_for_all_latin_greek_cyrillic(spark):
    chars = [chr(c) for c in range(0xC0, 0x530)] + [chr(c) for c in range(0x1E00, 0x2000)]
    chars = [c for c in chars if unicodedata.category(c)[0] in "LM"]
    # The closed form of "lower, decompose, drop marks", char by char.
    expected = []
    for c in chars:
        parts = unicodedata.normalize("NFD", c.lower())
        expected.append("".join(p for p in parts if unicodedata.category(p) != "Mn"))
    got = apply(spark, text.fold, chars)
    assert [(c, g) for c, g, e in zip(chars, got, expected, strict=True) if g != e] == []
    assert [text.fold_text(c) for c in chars] == expected


def test_repair_mojibake(spark):
    values = [
        "Comunidad autÃ³noma", "ï»¿Sexo", "﻿Sexo ", "España", "plain", "Ã", "año €", None,
        "naïve", "Ã\x83",
    ]
    assert apply(spark, text.repair_mojibake, values) == [
        "Comunidad autónoma", "Sexo", "Sexo", "España", "plain", "Ã", "año €", None, "naïve", "Ã",
    ]
    assert [text.repair_text(v) for v in values if v is not None] == [
        "Comunidad autónoma", "Sexo", "Sexo", "España", "plain", "Ã", "año €", "naïve", "Ã",
    ]


def test_repair_undoes_damage(spark):
    rng = random.Random(1)
    alphabet = "abc áéíóúñü €漢🔍ß\nÀ"
    texts = ["x" + "".join(rng.choices(alphabet, k=rng.randint(0, 60))) + "x" for _ in range(500)]
    damaged = [t.encode("utf-8").decode("latin-1") for t in texts]
    assert apply(spark, text.repair_mojibake, damaged) == texts


def test_white_space(spark):
    odd = " a\t\tb  c\n\xa0d e　\x1cf "
    assert apply(spark, text.ws_rejoin, [odd, "one", "", "  ", None]) == [
        "a b c d e f ", "one ", "", "", None,
    ]
    assert apply(spark, text.words, [odd, "one", "", "  "]) == [
        ["a", "b", "c", "d", "e", "f"], ["one"], [], [],
    ]
    rng = random.Random(2)
    samples = ["".join(rng.choices("ab \t\n\r\x0b\x0c\x1f\x85\xa0 ", k=30)) for _ in range(500)]
    assert apply(spark, text.words, samples) == [s.split() for s in samples]
    assert apply(spark, text.ws_rejoin, samples) == [
        "".join(w + " " for w in s.split()) for s in samples
    ]
    assert apply(spark, text.strip, samples) == [s.strip() for s in samples]


def test_terms(spark):
    values = ["el articulo", "que culo", "hijo de puta!", "disputa", "", None]
    substring = lambda c: text.contains_any(c, ["culo", "puta"])
    word = lambda c: text.contains_any(c, ["culo", "puta"], "word")
    assert apply(spark, substring, values) == [True, True, True, True, False, None]
    assert apply(spark, word, values) == [False, True, True, False, False, None]
    hits = lambda c: text.matched_terms(c, ["puta", "hijo de puta", "culo"], "word")
    assert apply(spark, hits, values[:3]) == [[], ["culo"], ["puta", "hijo de puta"]]
    many = [f"term{i}x" for i in range(100)]
    assert apply(spark, lambda c: text.contains_any(c, many), ["a term99x b", "term100"]) == [
        True, False,
    ]
    with pytest.raises(ValueError):
        text.contains_any(F.lit("a"), ["x", " "])
    with pytest.raises(ValueError):
        text.contains_any(F.lit("a"), [])


def test_parse_number_es(spark):
    cases = {
        "1.234,50": 1234.5, "43.829,0": 43829.0, "492.205": 492205.0, "1.737": 1737.0,
        "303.420": 303420.0, "385": 385.0, "2.5": 2.5, "9,9": 9.9, "1.234.567": 1234567.0,
        "-1.234": -1.234, "-1.234,5": -1234.5, " 12\xa0345,6 ": 12345.6, "..": None, "": None,
        "abc": None, "1d": None, "0x1p3": None, "1e3": 1000.0, ".5": 0.5, "5.": 5.0, "1,2,3": None,
        "1234.567": 1234567.0, "+7": 7.0, "nan": None, "--1": None, "e": None,
    }
    assert apply(spark, numbers.parse_number_es, list(cases)) == list(cases.values())
    assert apply(spark, numbers.parse_number_es, [None]) == [None]
    assert apply(spark, numbers.parse_number_es, ["inf"]) == [float("inf")]


def test_number_text(spark):
    values = [43829.0, 1234.5, 0.125, 1e6, -5.25, 1e20, None]
    assert apply(spark, numbers.format_number_es, values, "double") == [
        "43.829", "1.234,50", "0,12", "1.000.000", "-5,25", "100.000.000.000.000.000.000", None,
    ]
    values = [350.0, 324.84, 12345678.25, 12300000.0, 0.00012, 0.5]
    assert apply(spark, numbers.shortest_text, values, "double") == [repr(v) for v in values]
    assert apply(spark, numbers.kpi_licences, [100000.0, 100001.0, 1540000.0, 999.5], "double") == [
        "100,000", "0.1M", "1.5M", "1,000",
    ]
    assert apply(spark, numbers.kpi_spend, [2.5, 3.5, 295.4, 12345.0], "double") == [
        "€ 2", "€ 4", "€ 295", "€ 12345",
    ]
    assert apply(spark, lambda c: numbers.round_even(c, 4), [0.03125, 0.66666, 1.0], "double") == [
        0.0312, 0.6667, 1.0,
    ]


def test_number_round_trip(spark):
    rng = random.Random(3)
    values = [round(rng.uniform(0, 10 ** rng.randint(1, 9)), 2) for _ in range(2000)]
    back = apply(
        spark, lambda c: numbers.parse_number_es(numbers.format_number_es(c)), values, "double"
    )
    assert back == values


def test_periods(spark):
    assert apply(spark, periods.year_cast, ["2023", " 2023.0 ", "N/D", "2023.5", None, "-1"]) == [
        2023, 2023, None, None, None, -1,
    ]
    months = apply(spark, periods.month_label, ["2026. Mes 03", "2026. Mes 13", "2026", None])
    assert [str(m) if m else None for m in months] == ["2026-03-01", None, None, None]
    paths = ["data/raw/Habitos/2024_2025/f.csv", "raw/x/19/f.csv", "x2099y2020"]
    assert apply(spark, periods.path_year, paths) == ["2024", "N/D", "2099"]
    paths = ["data/RAW/Gasto_Hogares/a.csv", r"d:\p\raw\Deporte_Federado\x.csv", "a/b.csv", "raw"]
    assert apply(spark, periods.path_category, paths) == [
        "gasto_hogares", "deporte_federado", "", "",
    ]


def test_chat(spark):
    row = (
        spark.range(1)
        .select(chat.chat_record(F.lit(" q? "), F.lit("a.\n"), "sys").alias("m"))
        .withColumn("t", chat.chat_template(F.col("m")))
        .first()
    )
    assert [(m.role, m.content) for m in row.m] == [
        ("system", "sys"), ("user", "q?"), ("assistant", "a."),
    ]
    assert row.t == (
        "<|im_start|>system\nsys<|im_end|>\n<|im_start|>user\nq?<|im_end|>\n"
        "<|im_start|>assistant\na.<|im_end|>\n"
    )
    padded = apply(spark, lambda c: chat.pad_truncate(c, 3), ["a b", "a b c d", ""])
    assert [list(p.tokens) for p in padded] == [["a", "b", "<pad>"], ["a", "b", "c"], ["<pad>"] * 3]
    assert [list(p.attention_mask) for p in padded] == [[1, 1, 0], [1, 1, 1], [0, 0, 0]]
    assert apply(spark, lambda c: chat.within_budget(c, 2), ["a b", "a b c"]) == [True, False]


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0), (1.0, 3.0), (900.0, -900.0)], "n double, p double")
    rows = df.select(
        scores.softmax_positive(F.col("n"), F.col("p")).alias("s"),
        scores.argmax_label(F.col("n"), F.col("p")).alias("l"),
    ).collect()
    assert [r.l for r in rows] == [0, 1, 0]
    assert rows[0].s == 0.5 and abs(rows[1].s - 0.8807970779778823) < 1e-12 and rows[2].s == 0.0
    assert apply(spark, scores.over_threshold, [0.7, 0.69, None], "double") == [True, False, False]


def test_hash_share():
    assert hashing.hex_threshold(0.5) == "80000000"
    with pytest.raises(ValueError):
        hashing.hex_threshold(1.0)
