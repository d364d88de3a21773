"""Helpers that the training-data operators share: staging tables, Arrow plumbing and word hashing."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_own_dir: dict[str, str] = {}
_roots: set[tuple[str, str]] = set()
_staged: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or in local mode one of our own where it is unset (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        base = _own_dir.get(app) or _own_dir.setdefault(app, "file://" + tempfile.mkdtemp(prefix="lumafold-shared-"))
    root = f"{base.rstrip('/')}/lumafold-{spark.sparkContext.applicationId}"
    _roots.add((spark.sparkContext.applicationId, root))
    return root


def new_dir(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_dir(spark, name)
    df.write.parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lumafold_path = path
    return out


def drop_staged(*frames: DataFrame) -> None:
    """Delete staged tables that no returned plan reads any more."""
    for df in frames:
        path = getattr(df, "_lumafold_path", None)
        if path:
            _delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished steps now, instead of when the driver next collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes, at its end, all tables staged inside it but those passed to the function that it gives."""
    start, kept = len(_staged), set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._lumafold_path)
        return df

    yield keep
    for path in _staged[start:]:
        if path not in kept:
            _delete(spark, path)
    _staged[start:] = [p for p in _staged[start:] if p in kept]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def _clean() -> None:
    spark = SparkSession.getActiveSession()
    if spark is None or spark.sparkContext._jsc is None:
        return
    for app, root in list(_roots):
        if app == spark.sparkContext.applicationId:
            try:
                _delete(spark, root)
            except Exception:  # the JVM may be gone by now
                return


#: Repeated ids up to which only their rows get keys of their own; beyond, every row gets one.
FEW_REPEATED = 100_000


def text_key() -> Column:
    """A hash of ``text``: with doc_id it names a row up to rows that are equal in both."""
    return F.xxhash64(F.col("text").cast("string"))


def with_row_keys(docs: DataFrame, last_id: int) -> DataFrame:
    """``docs`` with __lf_doc (doc_id as a long, ``last_id`` for null) and __lf_key, which tells the rows of one id apart.

    The key is a hash of the text where rows share an id, so it is the same whenever the plan is read, and rows with
    the same id and text share it. Where an id has one row it is 0, which costs next to nothing in a shuffle.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(last_id))
    repeated = docs.select(doc.alias("__lf_many")).groupBy("__lf_many").count().where(F.col("count") > 1).select("__lf_many")
    many = [r[0] for r in repeated.limit(FEW_REPEATED + 1).collect()]
    keyed = docs.withColumn("__lf_doc", doc)
    if not many:
        return keyed.withColumn("__lf_key", F.lit(0).cast("long"))
    key = text_key()
    if len(many) > FEW_REPEATED:
        return keyed.withColumn("__lf_key", key)
    ids = docs.sparkSession.createDataFrame([(x,) for x in many], "__lf_many long")
    met = keyed.join(F.broadcast(ids), F.col("__lf_doc") == F.col("__lf_many"), "left")
    return met.withColumn("__lf_key", F.when(F.col("__lf_many").isNotNull(), key).otherwise(F.lit(0).cast("long"))).drop("__lf_many")


class OnceEach:
    """Remembers which repeated rows (doc, key) a task has met, up to ``cap`` of them: what it forgets is only done twice.

    Rows with key 0 are alone with their id and aren't remembered.
    """

    def __init__(self, cap: int = 100_000) -> None:
        self.cap, self.met = cap, set()

    def first(self, doc: int, key: int) -> bool:
        if not key:
            return True
        if (doc, key) in self.met:
            return False
        if len(self.met) >= self.cap:
            self.met.clear()
        self.met.add((doc, key))
        return True


def crc_mod5(column: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 5; null for a null id."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 5


_owner = ""
_clearers: dict[str, Callable[[], None]] = {}


def own_memory(name: str, clear: Callable[[], None]) -> None:
    """Called at the start of a task that fills a memo: worker processes live on from step to step, so the memos of other
    steps go first, and a worker holds one at a time."""
    global _owner
    _clearers[name] = clear
    if _owner != name:
        for other, drop in _clearers.items():
            if other != name:
                drop()
        gc.collect()
        _owner = name


class WordHashes:
    """64-bit hashes of words with a bounded two-generation memo."""

    def __init__(self, cap: int = 400_000) -> None:
        self.cap, self.young, self.old = cap, {}, {}

    def clear(self) -> None:
        self.young, self.old = {}, {}

    def of(self, words: list[bytes]) -> np.ndarray:
        young = self.young
        missing = set(words).difference(young)
        if missing:
            if len(young) > self.cap:
                self.old, self.young = young, {}
                young, missing = self.young, set(words)
            old, digest = self.old, xxhash.xxh3_64_intdigest
            for word in missing:
                known = old.get(word)
                young[word] = digest(word) if known is None else known
        return np.fromiter(map(young.__getitem__, words), np.uint64, len(words))


#: The memo of this worker process.
word_hashes = WordHashes()


#: Odd multipliers: the first for one hash of a window, the second for another half.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, list[np.ndarray]] = {}


def _power_tables(n: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    known = _powers.setdefault(multiplier, [])
    if not known or len(known[0]) < n:
        size = 1 << max(12, int(n - 1).bit_length())
        tables = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            tables.append(np.cumprod(table, dtype=np.uint64))
        known[:] = tables
    return known[0][:n], known[1][:n]


def mix64(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of MurmurHash3 (public domain): spreads every input bit over the word."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def rolling(hashes: np.ndarray, width: int, multiplier: int = MULTIPLIERS[0]) -> np.ndarray:
    """One 64-bit hash for each window of ``width`` consecutive words, independent of the window's place."""
    n = len(hashes)
    if n < width:
        return np.empty(0, np.uint64)
    power, inverse = _power_tables(n + 1, multiplier)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * power[:n], out=total[1:])
    k = n - width + 1
    return mix64((total[width:] - total[:k]) * inverse[:k])
