"""Tables that are only ever read whole: results keyed by the content of their inputs, and a commit log that says which are complete.

Under a root, an item (a table's name, or a frame's) of a mark (the inputs' fingerprint) is written to a folder of its own attempt, and
a line of the commit log names that folder once all its files are there. Readers follow the log alone, so what a lost
job left half written is never read, a rerun does only what the log lacks, and changed inputs have another mark.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterable, Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOG = "mark string, item string, attempt string"


def fingerprint(settings: Mapping[str, object], tables: Mapping[str, DataFrame] | None = None) -> str:
    """A mark for settings (anything JSON holds) and tables: of these, schema, row count and the sum of row hashes, so neither order nor partitions count."""
    seen: dict[str, object] = {"settings": settings}
    for name, table in sorted((tables or {}).items()):
        columns = sorted(table.columns)
        text = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
        row = table.agg(F.count("*").alias("n"), *[F.coalesce(F.sum(F.xxhash64(text, F.lit(seed)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(f"h{seed}") for seed in (1, 2)]).first()
        seen[name] = [sorted((f.name, f.dataType.simpleString()) for f in table.schema.fields), list(row)]
    return hashlib.sha256(json.dumps(seen, sort_keys=True, default=str).encode()).hexdigest()[:32]


def commits(spark: SparkSession, root: str, mark: str) -> dict[str, str]:
    """item to its attempt, for the complete items of a mark (a short line for each frame or table; the first attempt counts)."""
    try:
        log = spark.read.schema(LOG).parquet(f"{root}/_log")
        rows = log.where(F.col("mark") == mark).groupBy("item").agg(F.min("attempt").alias("attempt")).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return {}
    return {r["item"]: r["attempt"] for r in rows}


def _commit(spark: SparkSession, root: str, mark: str, done: Mapping[str, str]) -> None:
    """One file of the log, which Spark moves into place when it is whole."""
    spark.createDataFrame([(mark, item, attempt) for item, attempt in done.items()], LOG).coalesce(1).write.mode("append").parquet(f"{root}/_log")


def cached(root: str, mark: str, names: Iterable[str], make: Callable[[], Mapping[str, DataFrame]], spark: SparkSession) -> dict[str, DataFrame]:
    """The tables of these names: stored ones if all are complete for the mark, else made, written and committed together."""
    names = list(names)
    known = commits(spark, root, mark)
    if any(n not in known for n in names):
        made, attempt = make(), uuid.uuid4().hex
        if missing := [n for n in names if n not in made]:
            raise ValueError(f"not made: {missing}")
        for n in names:
            made[n].write.parquet(f"{root}/{mark}/{attempt}/{n}")
        _commit(spark, root, mark, {n: attempt for n in names if n not in known})
        known = commits(spark, root, mark)
    return {n: spark.read.parquet(f"{root}/{mark}/{known[n]}/{n}") for n in names}


def process_frames(root: str, mark: str, frames: Iterable[int], work: Callable[[list[int]], DataFrame], spark: SparkSession, batch: int = 8) -> list[int]:
    """Write the frames that aren't complete yet, ``batch`` to a job, each job committed before the next; the frames written are returned.

    ``work`` gives the rows (with a frame column) of a list of frames. A frame without rows is complete too.
    """
    known = commits(spark, root, mark)
    todo = [f for f in sorted(set(frames)) if str(f) not in known]
    for k in range(0, len(todo), batch):
        now, attempt = todo[k : k + batch], uuid.uuid4().hex
        rows = work(now)
        rows.where(F.col("frame").isin(now)).withColumn("frame_number", F.col("frame").cast("int")).write.partitionBy("frame_number").parquet(f"{root}/{mark}/attempt={attempt}")
        _commit(spark, root, mark, {str(f): attempt for f in now})
    return todo


def read_frames(root: str, mark: str, spark: SparkSession, frames: Iterable[int] | None = None) -> DataFrame:
    """The rows of all complete frames (or of those among ``frames``), one scan of their attempts' folders alone."""
    known = commits(spark, root, mark)
    wanted = known if frames is None else {str(f): known[str(f)] for f in frames if str(f) in known}
    if not wanted:
        raise ValueError("no frame is complete")
    paths = [f"{root}/{mark}/attempt={a}" for a in sorted(set(wanted.values()))]
    rows = spark.read.option("basePath", f"{root}/{mark}").parquet(*paths)
    return rows.where(F.col("frame_number").isin([int(f) for f in wanted])).drop("attempt", "frame_number")
