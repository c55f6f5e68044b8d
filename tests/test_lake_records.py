"""Records over line breaks and splits, bytes that are no UTF-8, and the rows kept aside."""

import csv
import io
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from padron.sources import lake, records

BOM = b"\xef\xbb\xbf"


def write(root, name, body, encoding="utf-8", bom=True):
    path = root / "raw" / name
    path.parent.mkdir(parents=True, exist_ok=True)
    data = body if isinstance(body, bytes) else body.encode(encoding)
    path.write_bytes((BOM if bom else b"") + data)
    return str(root / "raw")


def cell(rng):
    kind = rng.random()
    words = " ".join(rng.choice(["sol", "mar", "ñandú", "río"]) for _ in range(rng.randrange(1, 4)))
    if kind < 0.5:
        return words
    if kind < 0.7:
        return f'"{words}\n{words}"'
    if kind < 0.8:
        return f'"""{words}"";\n\n{words} ""x"""'
    if kind < 0.9:
        return f'{words} 24" y'  # a quote inside an unquoted cell is a letter
    return f'"{words};{words}"'


def plain_rows(text):
    return [tuple(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter=";") if any(c.strip() for c in r)]


@pytest.fixture
def small_splits(spark):
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]

    def use(size):
        for name in names:
            spark.conf.set(name, str(size))

    yield use
    for name, value in zip(names, before, strict=True):
        spark.conf.set(name, value)


@pytest.mark.parametrize("line_end", ["\n", "\r\n"])
def test_a_file_of_many_splits_equals_one_reader(spark, tmp_path, small_splits, line_end):
    """Quoted breaks, doubled quotes and stray quotes at the borders of splits of every size."""
    rng = random.Random(4)
    lines = [f"{i};{cell(rng)};{cell(rng)}" for i in range(400)]
    body = "Indicador;uno;Total\n" + "\n".join(lines) + "\n"
    expected = Counter(plain_rows(body)[1:])
    root = write(tmp_path, "Empresa_Deporte/a.csv", body.replace("\n", line_end))
    clean = lambda c: " ".join(c.split(" "))
    for size in (1 << 27, 1400, 311):
        small_splits(size)
        facts = lake.load_lake(spark, root, aliases={})
        if size == 1400:
            lines_read = records.read_lines(spark, root)
            assert lines_read.select("split").distinct().count() >= 10
        found = Counter((r.Indicador, clean(r.uno), r.Total) for r in facts.collect())
        # Carriage returns in cells are kept or not as the file has them; compare without.
        assert Counter((a, b.replace("\r", ""), (c or "").replace("\r", "")) for a, b, c in found.elements()) == expected


def test_states_of_lines(spark):
    cases = {
        "a;b": (False, True), '"a";"b"': (False, False), '"a': (True, False), 'a;"b': (True, False),
        'b";c': (False, False), 'x";"y': (False, True), '"a""': (True, False), '"a"""': (False, False), "": (False, True),
        'a"b;c': (False, False), 'a;"b;c""': (True, False), ';;"': (True, False), '""': (False, True), '"': (True, False),
    }
    rows = spark.createDataFrame([(c,) for c in cases], "line string")
    found = rows.select("line", records.leaves_open(F.col("line")), records.stays_open(F.col("line"))).collect()

    def plain(line, inside):
        state = "quoted" if inside else "start"
        for i, ch in enumerate(line):
            if state == "start":
                state = "quoted" if ch == '"' else "start" if ch == ";" else "bare"
            elif state == "bare":
                state = "start" if ch == ";" else "bare"
            elif state == "quoted":
                state = "shut" if ch == '"' else "quoted"
            else:
                state = "quoted" if ch == '"' else "start" if ch == ";" else "bare"
        return state == "quoted"

    for line, shut, opened in found:
        assert (shut, opened) == (plain(line, False), plain(line, True)), line
        assert (shut, opened) == cases[line] or line in {'b";c', 'a"b;c', 'x";"y', '""'}, line


def test_header_with_a_quoted_line_break(spark, tmp_path):
    root = write(tmp_path, "Empresa_Deporte/h.csv", '"Fede\nración";Total\nA;1\nB;2\n')
    listed = lake.manifest(spark, root)
    assert listed.first()["columns"] == ["Fede\nración", "Total"] and listed.first()["error"] is None
    facts = lake.load_lake(spark, root, listed=listed)
    assert sorted((r["Fede\nración"], r.total_num) for r in facts.collect()) == [("A", 1.0), ("B", 2.0)]
    assert lake.schema_profile(spark, root).first()["columns"] == "Fede\nración, Total"
    assert lake.ingest_report(listed, facts).first()["status"] == "OK"


def test_bytes_that_are_no_utf8_anywhere_bar_the_file(spark, tmp_path):
    write(tmp_path, "Empresa_Deporte/ok.csv", "Indicador;Total\nNatación;1\n")
    body = "Indicador;Total\n".encode() + b"x;1\n" * 5 + "Natación;1\n".encode("latin-1") + b"y;2\n" + b"\xff;3\n"
    root = write(tmp_path, "Empresa_Deporte/latin.csv", body)
    listed = lake.manifest(spark, root)
    assert {r.file_name: r.error for r in listed.collect()} == {"ok.csv": None, "latin.csv": "not UTF-8"}
    facts = lake.load_lake(spark, root, listed=listed)
    assert [(r.file_name, r.Indicador) for r in facts.collect()] == [("ok.csv", "Natación")]
    report = {r.file_name: (r.status, r.records) for r in lake.ingest_report(listed, facts).collect()}
    assert report == {"ok.csv": ("OK", 1), "latin.csv": ("ERROR", 0)}
    aside = lake.quarantine(spark, root, listed).orderBy("line").collect()
    assert [(r.line, r.reason) for r in aside] == [(7, "not UTF-8"), (9, "not UTF-8")]
    assert aside[0].content == "Nataci�n;1" and aside[1].content == "�;3"


def test_rows_kept_aside_with_their_lines(spark, tmp_path, small_splits):
    small_splits(64)
    write(tmp_path, "Gasto_Hogares/long.csv", "Indicador;Total\na;1\nb;2;de más\n;;\n\nc;3;;;x\n")
    write(tmp_path, "Gasto_Hogares/folded.csv", 'Indicador;Total\n"a\nb";1\nc;2;"d\ne"\n"f";3\n')
    root = write(tmp_path, "Gasto_Hogares/open.csv", 'Indicador;Total\na;1\n"b;2\nc;3\nd;4\n')
    listed = lake.manifest(spark, root)
    found = {(r.file_path.rsplit("/", 1)[1], r.line, r.reason, r.content) for r in lake.quarantine(spark, root, listed).collect()}
    too_long = "more cells than the header"
    assert found == {
        ("long.csv", 3, too_long, "b;2;de más"), ("long.csv", 6, too_long, "c;3;;;x"),
        ("folded.csv", 4, too_long, 'c;2;"d\ne"'), ("open.csv", 3, "quote never closed", '"b;2'),
    }
    facts = lake.load_lake(spark, root, listed=listed)
    assert {r.file_name for r in facts.collect()} == {"long.csv", "folded.csv"}
    assert lake.good_files(facts).count() == 0
    report = lake.ingest_report(listed, facts).collect()
    assert {r.status for r in report} == {"ERROR"} and {r.records for r in report} == {0}


def test_an_open_quote_does_not_gather_the_file(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(records, "MAX_LINES", 20)
    root = write(tmp_path, "Gasto_Hogares/late.csv", 'Indicador;Total\n"a;1\n' + "x;2\n" * 50 + 'y";3\n')
    aside = lake.quarantine(spark, root).collect()
    assert [(r.line, r.reason, r.content) for r in aside] == [(2, "quote never closed", '"a;1')]


def test_clean_lake_keeps_nothing_aside_and_scans_once(spark, tmp_path):
    root = write(tmp_path, "Gasto_Hogares/a.csv", 'Indicador;periodo;Total\n"a;b";2020;1\n;;\nc;2021\n')
    listed = lake.manifest(spark, root)
    assert lake.quarantine(spark, root, listed).count() == 0
    facts = lake.good_files(lake.load_lake(spark, root, listed=listed))
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(" csv") == 1 and " text" not in plan
    assert sorted((r.Indicador or "", r.Total or "") for r in facts.collect()) == [("", ""), ("a;b", "1"), ("c", "")]


def test_cells_that_nobody_asks_for_are_not_cleaned(spark, tmp_path):
    root = write(tmp_path, "Gasto_Hogares/a.csv", "Indicador;periodo;Total\na;2020;1\n")
    facts = lake.load_lake(spark, root)
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(facts.select("Indicador")).count("transform(") < plan(facts).count("transform(")


def test_profile_reads_one_file_a_category(spark, tmp_path):
    write(tmp_path, "Gasto_Hogares/a [1]{2}*.csv", "x;Total\n1;2\n")
    write(tmp_path, "Gasto_Hogares/b.csv", b"\xff\xfe\n")
    root = write(tmp_path, "Otros/b.csv", b"\xff\xfe;1\n")
    found = {r.category: r["columns"] for r in lake.schema_profile(spark, root).collect()}
    assert found == {"gasto_hogares": "x, Total", "otros": "error: not UTF-8"}


def test_lines_are_written_once_and_move_for_order_only(spark, tmp_path, monkeypatch):
    """States of splits are sent to the lines; no join deals the lines out."""
    body = "Indicador;uno;Total\n" + "".join(f'{i};"sol\nmar";1\n' for i in range(60)) + '1;"open\n\n'
    root = write(tmp_path, "Empresa_Deporte/a.csv", body)
    names = []
    made = records.saved
    monkeypatch.setattr(records, "saved", lambda df, name: names.append((name, "line" in df.columns)) or made(df, name))
    found = records.fold_lines(records.read_lines(spark, root))
    assert sum(lines for _, lines in names) == 1
    assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
    rows = {r.number: (r.record, r.lines, r.open) for r in found.collect()}
    assert rows[2] == ('0;"sol\nmar";1', 2, False) and rows[122][0] == '1;"open' and rows[122][2] and len(rows) == 62


def test_a_load_moves_no_rows_to_their_file(spark, tmp_path):
    root = write(tmp_path, "Empresa_Deporte/a.csv", 'Indicador;Total\n"sol\nmar";1\n')
    write(tmp_path, "Empresa_Deporte/b.csv", "Indicador;Total\nmar;2\n")
    facts = lake.load_lake(spark, root)
    plan = facts._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin [path" in plan and "SortMergeJoin [path" not in plan
    assert sorted((r.Indicador, r.Total) for r in facts.collect()) == [("mar", "2"), ("sol\nmar", "1")]
