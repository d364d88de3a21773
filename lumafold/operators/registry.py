"""Numbered entries: listing, reuse, allocation of free or oldest numbers, and the files that carry them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CAPACITY = 10_000
LEAST_CANDIDATES = 10


def parse_entries(lines: DataFrame, column: str = "value") -> DataFrame:
    """entry, mtime from lines "<mtime> pge<N>.entry"; other lines go."""
    pattern = r"^(\d+(?:\.\d+)?)\s+(?:.*/)?pge(\d+)\.entry$"
    hit = F.regexp_extract(column, pattern, 2)
    return lines.where(hit != "").select(hit.cast("int").alias("entry"), F.regexp_extract(column, pattern, 1).cast("double").alias("mtime"))


def parse_runs(lines: DataFrame, column: str = "value") -> DataFrame:
    """basename, entry from lines "<N> <basename>"."""
    parts = F.split(F.col(column), " ", 2)
    return lines.where(F.col(column).rlike(r"^\d+ .+")).select(parts[1].alias("basename"), parts[0].cast("int").alias("entry"))


def list_files(spark: SparkSession, folder: str, suffix: str = "pge") -> DataFrame:
    """path, basename, place of the folder's files in name order. Raises if there is none, or more than entries exist."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*.{suffix}").load(folder).select("path", F.element_at(F.split("path", "/"), -1).alias("basename"))
    n = files.limit(CAPACITY + 1).count()
    if not 0 < n <= CAPACITY:
        raise ValueError(f"expected 1 to {CAPACITY} files, found {'more' if n else 'none'}")
    return files.withColumn("place", F.row_number().over(Window.orderBy("path")))


def split_reused(files: DataFrame, runs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Files that have an entry already (with it), and the others."""
    return files.join(runs, "basename"), files.join(runs, "basename", "left_anti")


def candidates(entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """entry, rank: unused numbers ascending, then used ones from the oldest."""
    numbers = entries.sparkSession.range(capacity).select(F.col("id").cast("int").alias("entry"))
    unused = numbers.join(entries.select("entry"), "entry", "left_anti").select("entry", F.lit(0).alias("tier"), F.lit(0.0).alias("mtime"))
    used = entries.where(F.col("entry").between(0, capacity - 1)).groupBy("entry").agg(F.max("mtime").alias("mtime")).select("entry", F.lit(1).alias("tier"), "mtime")
    return unused.unionByName(used).withColumn("rank", F.row_number().over(Window.orderBy("tier", "mtime", "entry")))  # at most ``capacity`` rows


def allocate(files: DataFrame, entries: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """files (with place from 1) and entry: the file at place k takes the candidate of rank k."""
    return files.join(candidates(entries, capacity), F.col("place") == F.col("rank")).drop("rank")


def padded(entries: DataFrame, count: int, capacity: int = CAPACITY) -> tuple[DataFrame, DataFrame]:
    """The first ``count`` candidates, and as many spare ones again (at least LEAST_CANDIDATES)."""
    ranked = candidates(entries, capacity)
    spare = max(LEAST_CANDIDATES, count)
    return ranked.where(F.col("rank") <= count), ranked.where((F.col("rank") > count) & (F.col("rank") <= count + spare))


def claim(wanted: DataFrame, taken: DataFrame, count: int) -> DataFrame:
    """The first ``count`` candidates (entry, rank) that nobody else has taken."""
    return wanted.join(taken, "entry", "left_anti").orderBy("rank").limit(count)


def entry_text(path: Column) -> Column:
    """What an entry file holds: a line with 1 and a line with the path."""
    return F.concat(F.lit("1\n"), path, F.lit("\n"))


def assignment_report(assigned: DataFrame) -> DataFrame:
    return assigned.orderBy("entry").select("entry", "basename", F.when(F.col("tier") == 0, "new").otherwise("replaces").alias("how"))
