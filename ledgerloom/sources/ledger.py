"""Ledgers, payrolls and page caches as relations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import money, text

#: How headings are called.
DESCRIPTION = ["description", "short text", "=text", "document header text"]


def read_csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """(file, sheet, excel_row, hidden, cells) of a CSV whose header is somewhere; every cell is a string.

    Rows keep their physical number. Quoted cells may hold commas; a row is one line.
    """
    lines = spark.read.option("encoding", encoding).option("header", False).csv(path, schema=", ".join(f"c{i} string" for i in range(64)), multiLine=True)
    numbered = lines.select(F.array(*[f"c{i}" for i in range(64)]).alias("cells"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("at"))
    return numbered.select("file", F.lit("csv").alias("sheet"), (F.col("at") % (1 << 33) + 1).alias("excel_row"), F.lit(False).alias("hidden"), "cells")


def is_header(cells: Column) -> Column:
    """A cell that names a description and one that names an amount."""
    low = F.transform(cells, lambda c: F.trim(F.lower(F.coalesce(c, F.lit("")))))
    described = F.exists(low, lambda c: c.contains("description") | c.contains("short text") | (c == "text") | c.contains("document header text"))
    return described & F.exists(low, lambda c: c.contains("amount") | c.startswith("amt "))


def header_rows(rows: DataFrame) -> DataFrame:
    """(file, sheet, header_row, header): the first row of every sheet that looks like a header."""
    found = rows.where(is_header(F.col("cells"))).groupBy("file", "sheet").agg(F.min(F.struct("excel_row", "cells")).alias("h"))
    return found.select("file", "sheet", F.col("h.excel_row").alias("header_row"), F.col("h.cells").alias("header"))


def pick_column(header: Sequence[str | None], names: Sequence[str]) -> int | None:
    """The place of the first name that is a heading, case aside; else of the first a heading contains."""
    low = [(h or "").strip().lower() for h in header]
    for test in (lambda h, n: h == n, lambda h, n: n in h):
        for name in names:
            for i, h in enumerate(low):
                if h and test(h, name.lower()):
                    return i
    return None


def read_ledger(rows: DataFrame, doc_col: str | None = None) -> DataFrame:
    """One sheet's rows as a ledger (row_id, row_excel, <columns>, description, amount, cents, doc_norm, doc_digits, doc_isnum).

    The heading row is found, everything above it and hidden rows go. Columns keep
    their names; only the heading row reaches the driver.
    """
    head = header_rows(rows).first()
    if head is None:
        raise ValueError("no row has both a description and an amount heading")
    header = head["header"]
    about, amount = pick_column(header, ["description", "short text", "text", "document header text"]), pick_column(header, ["amount", "amt"])
    body = rows.where((F.col("file") == head["file"]) & (F.col("sheet") == head["sheet"]) & (F.col("excel_row") > head["header_row"]) & ~F.col("hidden"))
    seen: dict[str, int] = {}
    named = []
    for i, h in enumerate(header):
        if h and h.strip():
            name = h.strip()
            seen[name] = seen.get(name, 0) + 1
            named.append(F.get("cells", i).alias(name if seen[name] == 1 else f"{name}.{seen[name]}"))
    at = pick_column(header, [doc_col]) if doc_col else None
    if doc_col and at is None:
        raise ValueError(f"the ledger has no column {doc_col!r}")
    doc = F.lit(None).cast("string") if at is None else F.get("cells", at)
    norm = text.identifier(doc)
    digits = F.regexp_replace(norm, "[^0-9]", "")
    value = F.get("cells", amount).try_cast("double")
    return body.select(
        F.col("excel_row").alias("row_id"), F.col("excel_row").alias("row_excel"), F.struct(*named).alias("original"),
        F.get("cells", about).alias("description"), value.alias("amount"), money.cents(value).alias("cents"),
        doc.alias("docno"), norm.alias("doc_norm"), digits.alias("doc_digits"), (F.length(digits) >= 7).alias("doc_isnum"),
    )


def read_payroll(rows: DataFrame) -> DataFrame:
    """All sheets as (file, sheet, excel_row, fields map): the first row of a sheet heads it; blank rows and columns go."""
    heads = rows.where(~F.forall("cells", lambda c: c.isNull())).groupBy("file", "sheet").agg(F.min(F.struct("excel_row", "cells")).alias("h"))
    body = rows.join(heads, ["file", "sheet"]).where("excel_row > h.excel_row")
    pairs = F.filter(F.arrays_zip(F.col("h.cells").alias("k"), F.slice("cells", 1, F.greatest(F.size("h.cells"), F.lit(1))).alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull() & (F.trim(p["v"]) != ""))
    fields = F.map_from_entries(F.transform(F.array_distinct(pairs), lambda p: F.struct(p["k"], p["v"])))
    return body.where(F.size(pairs) > 0).select("file", "sheet", "excel_row", fields.alias("fields"))


def read_page_cache(spark: SparkSession, folders: Sequence[str]) -> DataFrame:
    """(file, page, text) from files ``<stem>_pNN.txt``; of several folders the first that has a document serves it."""
    every = None
    for rank, folder in enumerate(folders):
        df = spark.read.option("wholetext", True).text(folder).select(F.input_file_name().alias("path"), F.col("value").alias("text"))
        parts = F.regexp_extract("path", r"([^/]+)_p([0-9]+)\.txt$", 1), F.regexp_extract("path", r"([^/]+)_p([0-9]+)\.txt$", 2).try_cast("int")
        df = df.select(parts[0].alias("file"), parts[1].alias("page"), "text", F.lit(rank).alias("rank")).where("page is not null")
        every = df if every is None else every.unionByName(df)
    best = every.groupBy("file").agg(F.min("rank").alias("rank"))
    return every.join(best, ["file", "rank"]).select("file", "page", "text")


def write_reports(matches: DataFrame, annotated: DataFrame, out: str) -> None:
    """The match table and the annotated ledger, as Parquet below ``out``."""
    matches.write.mode("overwrite").parquet(f"{out}/matches")
    annotated.write.mode("overwrite").parquet(f"{out}/annotated_ledger")
