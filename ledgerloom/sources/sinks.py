"""Several tables of one run that appear together: the tables first, then a manifest that names them.

Tables go to a folder of their own attempt; readers find them only through the
manifest of the run, which is written last and in one file. A run that ends between two
tables leaves no manifest and so nothing to be read, and the manifest of the run before stays
valid. Repeating a run replaces its manifest. Folders that no manifest names are left
over from runs that ended early or were repeated; ``leftovers`` lists them.
"""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import predicates, text

MANIFEST = "name string, path string, n_rows long, finished_at double"


def page_tables(pages: DataFrame, words: DataFrame | None = None) -> dict[str, DataFrame]:
    """What a run keeps of its pages (file, page, text): ``dumps`` of all, ``garbage`` pages, an ``index``, and ``words`` where given.

    Unlike one text file that every document overwrites, a dump holds every page of every document.
    """
    marked = pages.select("file", "page", "text", predicates.is_garbage(F.coalesce("text", F.lit(""))).alias("garbage"))
    name = F.concat(text.safe_name(F.regexp_replace("file", r"\.[A-Za-z0-9]{1,5}$", "")), F.format_string("_p%02d.txt", F.col("page")))
    index = marked.select("file", "page", name.alias("name"), F.length("text").cast("long").alias("n_chars"), "garbage")
    tables = {"dumps": marked.select("file", "page", "text"), "garbage": marked.where("garbage").select("file", "page", "text"), "index": index}
    return tables | ({"words": words} if words is not None else {})


def write_run(tables: dict[str, DataFrame], out: str, run: str) -> None:
    """Write ``tables`` as the run ``run`` below ``out``; they can be read once all are there."""
    attempt, rows = f"{out}/data/{run}/{uuid.uuid4().hex}", []
    for name, df in tables.items():
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(f"{attempt}/{name}")
        rows.append((name, f"{attempt}/{name}", seen.get["n"], time.time()))
    if tables:
        spark = next(iter(tables.values())).sparkSession
        spark.createDataFrame(rows, MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{out}/manifest/run={run}")


def runs(spark: SparkSession, out: str) -> DataFrame:
    """(run, name, path, n_rows, finished_at) of every table of every finished run."""
    return spark.read.schema(MANIFEST + ", run string").option("basePath", f"{out}/manifest").parquet(f"{out}/manifest")


def read_run(spark: SparkSession, out: str, name: str, run: str | None = None) -> DataFrame:
    """The table ``name`` of ``run``, or of the run that finished last; LookupError where there is none."""
    found = runs(spark, out).where(F.col("name") == name)
    found = found.where(F.col("run") == run) if run is not None else found
    last = found.orderBy(F.desc("finished_at")).select("path").first()
    if last is None:
        raise LookupError(f"no finished run has {name}")
    return spark.read.parquet(last["path"])


def leftovers(spark: SparkSession, out: str) -> DataFrame:
    """(folder): attempts below ``out`` that no manifest names."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"{out}/data").select("path")
    folder = F.regexp_extract("path", r"(/data/[^/]+/[0-9a-f]{32})/", 1)
    kept = runs(spark, out).select(F.regexp_extract("path", r"(/data/[^/]+/[0-9a-f]{32})/", 1).alias("folder"))
    return files.select(folder.alias("folder")).where("folder <> ''").distinct().join(kept, "folder", "left_anti")
