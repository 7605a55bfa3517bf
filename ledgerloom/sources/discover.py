"""Which files of a folder tree are the ledger, the payroll, support and messages. Only paths are read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words in file names that tell a ledger; a parameter of :func:`ledger`.
LEDGER_WORDS = ("ledger", "actual", "posting", "report")
#: Words in file names that tell a payroll.
PAYROLL_WORDS = "schedule|payroll|salary|cpf|sdf"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, name, length, modified) of every file below ``root``; contents are never loaded."""
    df = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return df.select("path", file_name(F.col("path")).alias("name"), "length", F.col("modificationTime").alias("modified"))


def file_name(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]+)$", 1))


def is_temporary(name: Column) -> Column:
    return name.startswith("~$")


def _excel(name: Column) -> Column:
    return name.rlike(r"\.(?:xlsx|xlsm|xlsb|xls)$")


def _first(files: DataFrame, condition: Column, rank: Column) -> DataFrame:
    return files.where(condition & ~is_temporary(F.col("name"))).agg(F.min_by("path", F.struct(rank, "path")).alias("path"))


def ledger(files: DataFrame, words: tuple[str, ...] = LEDGER_WORDS) -> DataFrame:
    """One row: the ledger. A CSV report comes first, then names with one of ``words``; CSV before Excel, short names first."""
    n = F.col("name")
    csv = n.endswith(".csv")
    first = F.when(csv & n.contains("report"), 0).when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(n, w)), 1).otherwise(2)
    return _first(files, csv | _excel(n), F.struct(first, F.when(csv, 0).otherwise(1), F.length(n)))


def payroll(files: DataFrame) -> DataFrame:
    n = F.col("name")
    return _first(files, _excel(n) & n.rlike(PAYROLL_WORDS), F.struct(F.when(n.contains("payroll"), 0).otherwise(1), F.when(n.contains("posting"), 0).otherwise(1), F.length(n)))


def messages(files: DataFrame) -> DataFrame:
    n = F.col("name")
    return _first(files, n.rlike(r"\.(?:msg|txt)$"), F.struct(F.when(n.rlike("password|pwd"), 0).otherwise(1), F.when(n.contains("payroll"), 0).otherwise(1), F.length(n)))


def support(files: DataFrame, chosen: DataFrame) -> DataFrame:
    """(path): workbooks below a support folder, else all workbooks that aren't in ``chosen`` (path)."""
    folders = F.transform(F.slice(F.split(F.lower("path"), "/"), 1, F.size(F.split("path", "/")) - 1), lambda p: F.regexp_replace(p, " ", ""))
    books = files.where(_excel(F.col("name")) & ~is_temporary(F.col("name")))
    books = books.withColumn("below", F.exists(folders, lambda p: p.contains("support") | p.startswith("sup")))
    any_ = books.agg(F.coalesce(F.bool_or("below"), F.lit(False)).alias("any_below"))
    others = books.join(chosen.where("path is not null"), "path", "left_anti")
    return others.crossJoin(F.broadcast(any_)).where("below or not any_below").select("path")  # one row


def password(text: Column) -> Column:
    """The password a message tells, or null. It is never logged."""
    # How messages tell a password, in order of trust.
    forms = [r"(?i)pw\s*(?:for [^:]+)?:\s*([^\s\"']+)", r"(?i)password\s*[:=]\s*([^\s\"']+)", r"(?i)\bpass(?:word)?\s+is\s+\"?([^\s\"']+)\"?", r"(?i)\bpwd\s*[:=]\s*([^\s\"']+)"]
    found = [F.regexp_replace(F.regexp_extract(text, p, 1), r"\.$", "") for p in forms]
    return F.coalesce(*[F.when(F.length(x) >= 4, x) for x in found])
