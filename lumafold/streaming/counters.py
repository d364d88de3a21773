"""Running numbers of block logs that arrive as a stream: the pulse count and the open segment of each log, held as state.

In a table these are windows over a log (``counted``). In a stream (``counted_stream``) a processor holds, for each log,
the next row number, the pulses so far and the open segment, and lets rows out in the order of the log, whatever order
they arrive in. Rows after a gap wait in the state until it closes; rows that were let out already are dropped, so a
replayed batch changes nothing. The state lives in RocksDB beside the checkpoint, thus a restart goes on where it was.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lumafold.operators.events import sessions
from lumafold.operators.schedule import rf_phase

#: Columns that a log has: its name, the row number in it, the label that opens a segment (else null), and whether the row is a pulse.
LOG = "log string, n long, trid int, pulse boolean"
#: The same with the running numbers: segment, its instance and the place in it (both from 1; 0 before the first label), pulses so far.
COUNTED = "log string, n long, segment int, instance long, j long, pulses long"

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """State stores of the session's next queries keep their rows in RocksDB, which a stateful processor needs."""
    spark.conf.set(PROVIDER, ROCKSDB)


def counted(log: DataFrame) -> DataFrame:
    """COUNTED for a table of logs, by windows inside each log; a row that is given twice counts once."""
    rows = log.select("log", "n", "trid", "pulse").dropDuplicates(["log", "n"])
    w = Window.partitionBy("log").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    placed = sessions(rows, ["log"], ["n"], F.col("trid").isNotNull())
    placed = placed.withColumn("segment", F.last("trid", ignorenulls=True).over(w)).withColumn("pulses", F.sum(F.coalesce("pulse", F.lit(False)).cast("long")).over(w))
    j = F.when(F.col("instance") == 0, F.lit(0)).otherwise(F.col("j"))
    return placed.select("log", "n", "segment", F.col("instance").cast("long").alias("instance"), j.cast("long").alias("j"), "pulses")


class LogCounter(StatefulProcessor):
    """Numbers the rows of one log in its order; ``first`` is the number of a log's first row."""

    def __init__(self, first: int = 0) -> None:
        self.first = first

    def init(self, handle: StatefulProcessorHandle) -> None:
        # held: the least number among the rows that wait, so that these are read only when the log has come to them.
        self.place = handle.getValueState("place", "upcoming long, segment int, instance long, j long, pulses long, held long")
        self.waiting = handle.getListState("waiting", "n long, trid int, pulse boolean")

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        known = self.place.get()
        upcoming, segment, instance, j, pulses, held = known if known is not None else (self.first, None, 0, 0, 0, None)
        loose: pd.DataFrame | None = None
        loaded = False
        for part in rows:
            part = part[["n", "trid", "pulse"]]
            loose = part if loose is None else pd.concat([loose, part], ignore_index=True)
            while True:
                loose = loose[loose["n"] >= upcoming].drop_duplicates("n").sort_values("n", ignore_index=True)
                ready = int((loose["n"].to_numpy() == upcoming + np.arange(len(loose))).sum())
                if ready:
                    now, loose = loose.iloc[:ready], loose.iloc[ready:]
                    opens = now["trid"].notna().to_numpy()
                    place = np.arange(1, ready + 1)
                    opened = np.maximum.accumulate(np.where(opens, place, 0))  # place of the last label in these rows; 0: before them
                    labels = np.where(opens, now["trid"].fillna(0).to_numpy(), 0).astype("int64")
                    before = opened == 0
                    names = pd.array(labels[np.maximum(opened, 1) - 1], dtype="Int32")
                    names[before] = pd.NA if segment is None else segment
                    instances = instance + np.cumsum(opens)
                    spots = np.where(before, np.where(instance > 0, j + place, 0), place - opened + 1)
                    counts = pulses + np.cumsum(now["pulse"].fillna(False).astype(bool).to_numpy())
                    yield pd.DataFrame({"log": key[0], "n": now["n"].to_numpy(), "segment": names, "instance": instances, "j": spots, "pulses": counts})
                    upcoming, instance, j, pulses = upcoming + ready, int(instances[-1]), int(spots[-1]), int(counts[-1])
                    segment = None if names[-1] is pd.NA else int(names[-1])
                if loaded or held is None or held > upcoming:
                    break
                stored = [tuple(r) for r in self.waiting.get()]
                loose = pd.concat([loose, pd.DataFrame(stored, columns=["n", "trid", "pulse"])], ignore_index=True)
                self.waiting.clear()
                loaded, held = True, None
        if loose is not None and len(loose):
            self.waiting.appendList([(int(n), None if pd.isna(t) else int(t), None if pd.isna(p) else bool(p)) for n, t, p in loose.itertuples(index=False)])
            least = int(loose["n"].min())
            held = least if held is None else min(held, least)
        self.place.update((upcoming, segment, instance, j, pulses, held))


def counted_stream(log: DataFrame, first: int = 0) -> DataFrame:
    """COUNTED by the stateful processor, for a stream of LOG rows; where a log has no gap, the same rows as ``counted`` gives for a table."""
    if not log.isStreaming:
        raise ValueError("a table of logs is counted by counted()")
    rows = log.select("log", "n", "trid", "pulse")
    return rows.groupBy("log").transformWithStateInPandas(LogCounter(first), COUNTED, "Append", "None")


def with_phase(numbered: DataFrame, increment: float = 117.0) -> DataFrame:
    """Adds phase, the quadratic spoiling phase of the pulse count in degrees."""
    return numbered.withColumn("phase", rf_phase(F.col("pulses"), increment))


def write_counted(log: DataFrame, out: str, checkpoint: str, first: int = 0) -> StreamingQuery:
    """Append the counted rows of a stream to ``out``, each once, until its source is read up to now."""
    use_rocksdb(log.sparkSession)
    return counted_stream(log, first).writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
