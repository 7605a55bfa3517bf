import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerloom.config import ReconcileConfig
from ledgerloom.sources import discover, ledger, xlsx
from ledgerloom.streaming import pages

NS = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def workbook(path, sheets):
    """A small workbook: {name: [(hidden, [cells])]}, texts as shared strings."""
    strings, bodies = [], []
    for rows in sheets.values():
        body = ""
        for i, (hidden, cells) in enumerate(rows, 1):
            body += f'<row r="{i}"{" hidden=\"1\"" if hidden else ""}>'
            for j, c in enumerate(cells):
                if isinstance(c, str):
                    strings.append(c)
                    body += f'<c r="{chr(65 + j)}{i}" t="s"><v>{len(strings) - 1}</v></c>'
                elif c is not None:
                    body += f'<c r="{chr(65 + j)}{i}"><v>{c}</v></c>'
            body += "</row>"
        bodies.append(f"<worksheet {NS}><sheetData>{body}</sheetData></worksheet>")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f"<workbook {NS}><sheets>" + "".join(f'<sheet name="{n}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i}" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        z.writestr("xl/sharedStrings.xml", f"<sst {NS}>" + "".join(f"<si><t>{s}</t></si>" for s in strings) + "</sst>")
        for i, b in enumerate(bodies, 1):
            z.writestr(f"xl/worksheets/sheet{i}.xml", b)


def test_workbook_ledger(spark, tmp_path):
    rows = [(False, ["Company report"]), (False, ["Doc No", "Short Text", "Amount", "Posting date"]), (False, ["INV-1", "Lunch", 12.5, 45869]), (True, ["INV-2", "hidden", 1.0, 45869]), (False, ["12.0", "Taxi", "x", "31/7/2025"])]
    workbook(tmp_path / "ledger.xlsx", {"Sheet A": rows})
    workbook(tmp_path / "~$ledger.xlsx", {"Sheet A": rows})
    raw = xlsx.read_workbooks(spark, str(tmp_path))
    assert raw.count() == 5 and raw.where("hidden").count() == 1
    book = ledger.read_ledger(raw, "Doc No").orderBy("row_id").collect()
    assert [(r["row_excel"], r["description"], r["cents"], r["doc_norm"]) for r in book] == [(3, "Lunch", 1250, "INV1"), (5, "Taxi", None, "12")]
    assert book[0]["original"]["Posting date"] == "45869"
    with pytest.raises(ValueError, match="no column"):
        ledger.read_ledger(raw, "Missing")
    with pytest.raises(ValueError, match="heading"):
        ledger.read_ledger(raw.where("excel_row = 1"))


def test_plain_files_are_no_workbooks():
    with pytest.raises(ValueError, match="zip-based"):
        list(xlsx.read_workbook("old.xls", b"\xd0\xcf\x11\xe0"))


def test_decryption_happens_in_the_task(spark, tmp_path):
    workbook(tmp_path / "a.xlsx", {"S": [(False, ["k", "v"]), (False, ["x", 1])]})
    data = (tmp_path / "a.xlsx").read_bytes()
    (tmp_path / "a.xlsx").write_bytes(bytes(b ^ 7 for b in data))
    assert xlsx.read_workbooks(spark, str(tmp_path), lambda name, d: bytes(b ^ 7 for b in d)).count() == 2


def test_csv_ledger_and_payroll(spark, tmp_path):
    path = tmp_path / "report.csv"
    path.write_text('Banner,,\nDescription,Amount,Doc\n"Lunch, big",12.50,A1\nBad,"1,234.50",A2\n')
    book = ledger.read_ledger(ledger.read_csv_rows(spark, str(path)), "Doc").orderBy("row_id").collect()
    assert [(r["row_excel"], r["description"], r["cents"]) for r in book] == [(3, "Lunch, big", 1250), (4, "Bad", None)]
    rows = spark.createDataFrame([("f", "s", 1, [None, None]), ("f", "s", 2, ["Name", "Net"]), ("f", "s", 3, ["Ann", "5"]), ("f", "s", 4, [None, None]), ("f", "t", 1, ["Net", "Date"]), ("f", "t", 2, ["7", None])], "file string, sheet string, excel_row long, cells array<string>")
    assert {(r["sheet"], tuple(sorted(r["fields"].items()))) for r in ledger.read_payroll(rows).collect()} == {("s", (("Name", "Ann"), ("Net", "5"))), ("t", (("Net", "7"),))}
    assert ledger.pick_column(["Net Pay", "net"], ["net"]) == 1 and ledger.pick_column(["Net Pay"], ["net"]) == 0 and ledger.pick_column([None], ["x"]) is None


def test_discovery(spark, tmp_path):
    for name in ("account report.csv", "actual.xlsx", "~$actual.xlsx", "payroll posting.xlsx", "pwd payroll.txt", "Sup port docs/jul 25.xlsx", "notes.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("x")
    files = discover.list_files(spark, str(tmp_path))
    pick = lambda df: df.first()["path"].rsplit("/", 1)[1]
    assert pick(discover.ledger(files)) == "account%20report.csv" or pick(discover.ledger(files)) == "account report.csv"
    assert "payroll" in pick(discover.payroll(files)) and "pwd" in pick(discover.messages(files))
    chosen = discover.ledger(files).union(discover.payroll(files))
    assert [pick(discover.support(files, chosen)).replace("%20", " ")] == ["jul 25.xlsx"]
    empty = files.where("false")
    assert discover.ledger(empty).first()["path"] is None and discover.support(empty, chosen).count() == 0


@pytest.mark.parametrize(("text", "want"), [("pw for file: s3cret.", "s3cret"), ("Password = abcd", "abcd"), ("the password is \"open sesame\"", "open"), ("pwd: abc", None), ("nothing", None)])
def test_passwords(spark, text, want):
    assert spark.createDataFrame([(text,)], "t string").select(discover.password(F.col("t"))).first()[0] == want


def test_page_cache_and_stream(spark, tmp_path):
    for folder, texts in (("shared", {"a_p01": "SGD 1/2/2025 lunch 5.00", "a_p02": "x"}), ("own", {"a_p01": "other", "b_p01": "SGD 1/2/2025 taxi 7.50"})):
        (tmp_path / folder).mkdir()
        for name, text in texts.items():
            (tmp_path / folder / f"{name}.txt").write_text(text)
    cache = ledger.read_page_cache(spark, [str(tmp_path / "shared"), str(tmp_path / "own")])
    assert {(r["file"], r["page"], r["text"][:3]) for r in cache.collect()} == {("a", 1, "SGD"), ("a", 2, "x"), ("b", 1, "SGD")}
    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    for _ in range(2):  # the second run finds nothing new
        pages.ingest_receipts(spark, str(tmp_path / "shared"), out, check).awaitTermination()
    assert [r["description"] for r in spark.read.parquet(out).collect()] == ["lunch"]


def test_periods_must_be_dates():
    assert ReconcileConfig.period("2025-01-31", None)[1] is None
    with pytest.raises(ValueError):
        ReconcileConfig.period("2025-06-31", None)


def test_reports(spark, tmp_path):
    df = spark.range(3)
    ledger.write_reports(df, df, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "matches")).count() == 3


def test_tables_of_a_run_appear_together(spark, tmp_path):
    from ledgerloom.sources import sinks

    df = spark.createDataFrame([("a b.pdf", 1, "plain words of a page that read well enough"), ("a b.pdf", 2, "\x00\x01\x02"), ("c.pdf", 1, None)], "file string, page int, text string")
    out = str(tmp_path / "run")
    sinks.write_run(sinks.page_tables(df), out, "one")
    assert {r["name"]: r["n_rows"] for r in sinks.runs(spark, out).collect()} == {"dumps": 3, "garbage": 2, "index": 3}
    assert {(r["name"], r["garbage"]) for r in sinks.read_run(spark, out, "index").collect()} == {("a_b_p01.txt", False), ("a_b_p02.txt", True), ("c_p01.txt", True)}
    # A run that ends between two sinks.
    broken = sinks.page_tables(df.limit(1)) | {"late": df.select(F.raise_error(F.lit("lost")).cast("string").alias("x"))}
    with pytest.raises(Exception, match="lost"):
        sinks.write_run(broken, out, "two")
    assert sinks.read_run(spark, out, "dumps").count() == 3 and sinks.leftovers(spark, out).count() == 1
    with pytest.raises(LookupError):
        sinks.read_run(spark, out, "dumps", "two")
    # Repeated, and the first run replaced.
    sinks.write_run(sinks.page_tables(df.limit(1)), out, "two")
    assert sinks.read_run(spark, out, "dumps").count() == 1 and sinks.read_run(spark, out, "dumps", "one").count() == 3
    sinks.write_run(sinks.page_tables(df.limit(2)), out, "one")
    assert sinks.read_run(spark, out, "dumps", "one").count() == 2 and sinks.runs(spark, out).count() == 6 and sinks.leftovers(spark, out).count() == 2
