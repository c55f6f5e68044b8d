"""Readers, writers and the lake on small files."""

import json
import re
from pathlib import Path

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from padron.lookups import ZONE_COL
from padron.operators import generators
from padron.operators.columns import add_metadata
from padron.operators.contracts import contract_checks
from padron.session import discard, saved, scratch_dir
from padron.sources import files, lake

BOM = "﻿"
LAKE = {
    "Deporte_Federado/federado_01.csv": "Federación;Sexo;Comunidad autónoma;periodo;Total\n"
    "FÚTBOL;Mujeres;Galicia;2023;1.234\nTOTAL;;Aragón;2023;..\n",
    "Gasto_Publico/gasto_05.csv": 'Comunidad autónoma;periodo;Total\nTOTAL;2023;492.205\n"A;B";2023;303.420\n',
    "Gasto_Hogares/gasto_01.csv": "Indicador;periodo;Total\nGasto total;2023;6.326,0\n",
    "Habitos_Deportivos/2022/P/practica_03.csv": "Comunidad autónoma y tamaño de municipio;Indicador;periodo;Total\n"
    "TOTAL;Practican;2022;57,3\n",
    "Habitos_Deportivos/2024_2025/P/practica_03.csv": "Comunidad autónoma-tamaño de municipio;Indicador;Total\n"
    "Galicia; Practican ;62,7\n",
    "Habitos_Deportivos/2020/P/practica_03.csv": "Tamaño del municipio;Indicador;Total\nGrande;Practican;59,6\n",
    "Indicadores_Afiliacion/indi_01.csv": "Tipo de indicador;Actividad económica;Sexo;Periodo;Total\n"
    "TOTAL;Comercio;Total;2026. Mes 03;39.777\n",
    "Empresa_Deporte/roto.csv": "Indicador;Actividad económica;periodo;Total\nX;Y;2024;1\nX;Y;2024;2;de más\n",
    "Empresa_Deporte/corto.csv": "Indicador;Actividad económica;periodo;Total\nX;Y;2024;43.829,00\nX;Z\n",
    "Empleo_Deporte/Medias_Anuales/sin.csv": "Indicador;Sexo;periodo\nA;B;2024\n",
    "Gasto_Hogares/a+b 50%25 [1]{2}.csv": "Indicador;periodo;Total\nGasto raro;2023;1\n",
    "Otros/x.csv": "Indicador;Total\nA;1\n",
}


@pytest.fixture
def root(tmp_path):
    # A parent folder with a year in its name must not count as a wave.
    base = tmp_path / "copy 2099" / "raw"
    for name, body in LAKE.items():
        path = base / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(BOM + body, encoding="utf-8")
    (base / "readme.txt").write_text("no data")
    return str(base)


def test_discover(spark, root):
    rows = {(r.category, r.wave, r.file_name, r.year) for r in lake.discover(spark, root).collect()}
    assert len(rows) == len(LAKE)
    assert ("habitos_deportivos", "2024_2025", "practica_03.csv", "2024") in rows
    assert ("deporte_federado", None, "federado_01.csv", "N/D") in rows


def test_load_lake(spark, root):
    facts = lake.load_lake(spark, root)
    rows = facts.collect()
    assert len(rows) == sum(body.count("\n") - 1 for body in LAKE.values())
    by_file = {}
    for r in rows:
        by_file.setdefault((r.category, r.wave, r.file_name), []).append(r)
    federated = by_file[("deporte_federado", None, "federado_01.csv")]
    assert sorted((r["Federación"], r["Sexo"], r.total_num) for r in federated if r["Sexo"]) == [
        ("FÚTBOL", "Mujeres", 1234.0)
    ]
    assert [r["Comunidad autónoma"] for r in federated if r.Total == ".."] == ["Aragón"]
    public = by_file[("gasto_publico", None, "gasto_05.csv")]
    assert {r["Comunidad autónoma"]: r.total_num for r in public} == {"TOTAL": 492205.0, "A;B": 303420.0}
    zones = {r.wave: (r[ZONE_COL], r.Indicador, r.total_num) for r in rows if r.category == "habitos_deportivos"}
    assert zones == {
        "2022": ("TOTAL", "Practican", 57.3), "2024_2025": ("Galicia", "Practican", 62.7),
        "2020": ("Grande", "Practican", 59.6),
    }
    assert [r.file_name for r in rows if r.overlong] == ["roto.csv"]
    short = by_file[("empresa_deporte", None, "corto.csv")]
    assert sorted((r["Actividad económica"], r.Total) for r in short if r.Total) == [("Y", "43.829,00")]
    kept = {r.file_name for r in lake.good_files(facts).select("file_name").distinct().collect()}
    assert "roto.csv" not in kept and "corto.csv" in kept


def scans(df) -> int:
    return df._jdf.queryExecution().optimizedPlan().toString().count(" csv")


def test_any_number_of_layouts_is_one_scan(spark, tmp_path):
    base = tmp_path / "raw"
    for n in range(40):
        path = base / f"F{n % 7}" / f"{n}.csv"
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(f"col{n};Total\nv{n};{n}\n", encoding="utf-8")
    (base / "F0" / "source.csv").mkdir()
    (base / "F0" / "source.csv" / "part-0.csv").write_text("col0;Total\npart;7\n")
    facts = lake.load_lake(spark, str(base))
    assert scans(facts) == 1
    rows = facts.collect()
    seen = {next(r[f"col{n}"] for n in range(40) if r[f"col{n}"]) for r in rows}
    assert seen == {f"v{n}" for n in range(40)} | {"part"} and len(rows) == 41
    assert sum(r.total_num for r in rows) == sum(range(40)) + 7
    sources = {r.source_path.rsplit("/", 1)[1] for r in rows}
    assert "source.csv" in sources and "part-0.csv" not in sources


def test_quoted_header_and_cells_with_line_breaks(spark, tmp_path):
    path = tmp_path / "raw" / "Empresa_Deporte" / "q.csv"
    path.parent.mkdir(parents=True)
    path.write_text('"Indicador";"Actividad; dos";"Total"\n"a\nb";Z;3\nc;Y;4\n', encoding="utf-8")
    root = str(tmp_path / "raw")
    rows = lake.load_lake(spark, root).collect()
    assert sorted((r.Indicador, r["Actividad; dos"], r.total_num) for r in rows) == [("a\nb", "Z", 3.0), ("c", "Y", 4.0)]
    report = lake.ingest_report(lake.manifest(spark, root), lake.load_lake(spark, root)).first()
    assert (report.status, report.with_total) == ("OK", 2)
    assert lake.schema_profile(spark, root).first()["columns"] == "Indicador, Actividad; dos, Total"


def test_unreadable_file_is_named_and_the_load_goes_on(spark, root):
    bad = Path(root) / "Empresa_Deporte" / "latin.csv"
    bad.write_bytes("Indicador;Año;Total\nA;1;2\n".encode("latin-1"))
    (Path(root) / "Empresa_Deporte" / "leer.csv").write_text("")
    listed = lake.manifest(spark, root)
    facts = lake.load_lake(spark, root, listed=listed)
    names = {r.file_name for r in facts.select("file_name").distinct().collect()}
    assert "latin.csv" not in names and "corto.csv" in names
    report = {r.file_name: r.status for r in lake.ingest_report(listed, facts).collect()}
    assert report["latin.csv"] == "ERROR" and "leer.csv" not in report  # no bytes, no file
    with pytest.raises(FileNotFoundError):
        lake.load_lake(spark, str(Path(root) / "Otros" / "none"), listed=listed.filter("false"))


def test_report(spark, root):
    report = lake.ingest_report(lake.manifest(spark, root), lake.load_lake(spark, root)).collect()
    status = {(r.file_name, r.wave): (r.status, r.rows, r.records) for r in report}
    assert status[("federado_01.csv", None)] == ("OK", 2, 1)
    assert status[("roto.csv", None)] == ("ERROR", 2, 0)
    assert status[("sin.csv", None)] == ("SKIP_NO_TOTAL", 1, 0)
    assert status[("x.csv", None)] == ("SKIP_CATEGORY", 1, 0)
    assert len(status) == len(LAKE)


def test_profile_and_headers(spark, root):
    profile = {r.category: r["columns"] for r in lake.schema_profile(spark, root).collect()}
    assert profile["gasto_hogares"] == "Indicador, periodo, Total"
    assert profile["deporte_federado"].startswith("Federación, ")
    assert lake.header_columns('"a;b";x;X;comunidad autÃ³noma') == ["a;b", "x", "X_1", "comunidad autónoma"]


def test_lake_to_cards_for_all_regions(spark, tmp_path):
    """Files with the licence side's spelling meet the spend side's through the fixed map."""
    from padron.lookups import LICENCE_FILE, REGIONS, SPEND_FILE, SPEND_INDICATOR
    from padron.operators import indicators

    base = tmp_path / "raw"
    for folder, name, head, line in (
        ("Deporte_Federado", LICENCE_FILE, "Federación;Comunidad autónoma;periodo;Total", "TOTAL;{r};2023;1.000"),
        ("Gasto_Hogares", SPEND_FILE, "Indicador;Comunidad autónoma;periodo;Total", SPEND_INDICATOR + ";{s};2023;250,5"),
    ):
        (base / folder).mkdir(parents=True)
        lines = [line.format(r=r, s=re.sub("^(.+), (.+)$", r"\1 (\2)", r)) for r in REGIONS]
        (base / folder / name).write_text("\n".join([head, *lines]) + "\n", encoding="utf-8")
    licences, spend = lake.indicator_tables(lake.load_lake(spark, str(base)))
    card = indicators.kpis(indicators.home_indicators(licences, spend, 2023)).first()
    assert (card.n_regions, card.avg_spend, card.sum_licences) == (17, 250.5, 17000.0)


def test_lake_pairs(spark, root):
    facts = lake.good_files(lake.load_lake(spark, root))
    pairs = {r.question: r.answer for r in generators.lake_pairs(facts, ["file_path"]).collect()}
    assert pairs == {
        "¿Cuántos deportistas de FÚTBOL (mujeres) en Galicia en 2023?":
            "El número de deportistas de la federación FÚTBOL en Galicia en el periodo 2023 fue de 1.234.",
        "¿Cuál fue el gasto deportivo en TOTAL en 2023?": "El gasto deportivo en TOTAL en 2023 fue de 492.205.",
        "¿Cuál fue el gasto deportivo en A;B en 2023?": "El gasto deportivo en A;B en 2023 fue de 303.420.",
        "¿Cuál fue el gasto raro en 2023?": "El gasto raro en 2023 fue de 1.",
        "¿Cuál fue el gasto total en 2023?": "El gasto total en 2023 fue de 6.326.",
        "¿Cuál fue el porcentaje de 'Practican' en TOTAL (encuesta 2022)?":
            "Según la encuesta de hábitos deportivos de 2022, el indicador 'Practican' en TOTAL fue del 57,30%.",
        "¿Cuál fue el porcentaje de 'Practican' en Galicia (encuesta 2024)?":
            "Según la encuesta de hábitos deportivos de 2024, el indicador 'Practican' en Galicia fue del 62,70%.",
        "¿Cuál fue el porcentaje de 'Practican' en Grande (encuesta 2020)?":
            "Según la encuesta de hábitos deportivos de 2020, el indicador 'Practican' en Grande fue del 59,60%.",
        "¿Cuál fue el indicador de 'TOTAL' para Total, actividad 'Comercio' en 2026. Mes 03?":
            "El indicador 'TOTAL' para Total en 2026. Mes 03 fue de 39.777.",
        "¿Qué valor tuvo 'X' en la actividad Y en 2024?":
            "El indicador 'X' para la actividad económica Y en 2024 fue de 43.829.",
    }


def test_csv_round_trip(spark, tmp_path):
    texts = ['a "quoted" text', "comma, and\nnew line", " spaces ", "back\\slash", "ñ 🔍", 'end "', "'; --", "a\\"]
    df = spark.createDataFrame([(t, i % 2) for i, t in enumerate(texts)], "text string, label int")
    files.write_csv(df, str(tmp_path / "t"))
    back = files.read_labelled_csv(spark, str(tmp_path / "t")).collect()
    assert sorted(back) == sorted(df.collect())


def test_typed_scan(spark, tmp_path):
    (tmp_path / "c.csv").write_text(
        "CCAA,Gasto_Promedio_Hogar_Eur,Licencias_Federadas,Poblacion_Activa_Dep\n"
        'Galicia,276.71,81105,121657\n"Rioja, La",249.36,73240,109861\n', encoding="utf-8"
    )
    df = files.read_comma(spark, str(tmp_path / "c.csv"))
    assert {r.CCAA: r.Licencias_Federadas for r in df.collect()} == {"Galicia": 81105, "Rioja, La": 73240}
    (tmp_path / "bad.csv").write_text("a,b,c,d\nx,not a number,1,1\n")
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_comma(spark, str(tmp_path / "bad.csv")).collect()


def test_jsonl(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"text": "ñ", "label": 1}\n\n  \n{"text": "b", "label": 0}\n', encoding="utf-8")
    assert files.read_jsonl(spark, str(good), files.LABELLED_SCHEMA).count() == 2
    (tmp_path / "b.jsonl").write_text('{"text": \n')
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_jsonl(spark, str(tmp_path / "b.jsonl"), files.LABELLED_SCHEMA).collect()
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_jsonl(spark, str(tmp_path / "none"), files.LABELLED_SCHEMA).collect()
    out = tmp_path / "out"
    files.write_jsonl(spark.createDataFrame([("ñandú", 1)], "text string, label int"), str(out))
    line = "".join(p.read_text(encoding="utf-8") for p in Path(out).glob("*.json"))
    assert json.loads(line) == {"text": "ñandú", "label": 1} and "ñandú" in line


def test_partitioned(spark, tmp_path):
    out = str(tmp_path / "p")
    base = spark.range(17).withColumn("v", F.lit("old"))
    for year in (2022, 2023):
        files.write_partitioned(add_metadata(base, year, "s"), out, "anio")
    files.write_partitioned(add_metadata(spark.range(3).withColumn("v", F.lit("new")), 2023, "s"), out, "anio")
    back = spark.read.parquet(out)
    counts = {(r.anio, r.v): r["count"] for r in back.groupBy("anio", "v").count().collect()}
    assert counts == {(2022, "old"): 17, (2023, "new"): 3}
    check = contract_checks(back.filter("anio = 2022"), ["id", "fuente"], 17, {"anio": 2022, "fuente": "s"}).first()
    assert check.rows_ok and check.anio_ok and check.fuente_ok


class FakeSession:
    def __init__(self, master, **conf):
        self.conf, self.sparkContext = conf, self
        self.master = master


def test_scratch_dir_follows_the_session():
    cluster = FakeSession("yarn", **{"spark.checkpoint.dir": "s3a://bucket/tmp/"})
    one, two = scratch_dir(cluster, "x"), scratch_dir(cluster, "x")
    assert one.startswith("s3a://bucket/tmp/padron/x-") and one != two
    with pytest.raises(RuntimeError):
        scratch_dir(FakeSession("yarn"), "x")
    assert scratch_dir(FakeSession("local[2]"), "x")


def test_scratch_folders_are_removed(spark):
    from padron import session

    kept = saved(spark.range(3), "gone").inputFiles()
    path = Path(kept[0].removeprefix("file:")).parent
    assert path.exists() and any(str(path).endswith(p.rsplit("/", 1)[1]) for p in session._MADE)
    session_made = [p for p in session._MADE if p.rsplit("/", 1)[1] == path.name]
    others = [p for p in session._MADE if p not in session_made]
    session._MADE[:] = session_made
    discard(spark)
    session._MADE[:] = others
    assert not path.exists()
