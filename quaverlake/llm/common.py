"""Helpers shared by the corpus operators."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as the operators on words define it.
ASCII_SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where a session on one machine names none, a temporary folder is made and kept
    for the rest of the session; a cluster without that setting is an error.
    """
    sc = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured.rstrip("/")
    if current is None:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="shared-"))
        current = sc.getCheckpointDir()
    return current.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise a DataFrame in the shared folder and cut its lineage there."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def saved(df: DataFrame, label: str, path: str | None = None) -> DataFrame:
    """As ``cut``, but as a table, whose size decides whether a join may broadcast it."""
    path = path or new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000) -> Iterator[None]:
    """Plans made meanwhile send their rows to Python by so many: a worker and its JVM hold a batch several times over, as texts and as results."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def discard(spark: SparkSession, *folders: str) -> None:
    """Deletes folders of the shared folder that nothing reads any more, and lets Spark delete the shuffles of plans that are no longer referred to."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for folder in folders:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)
    # Spark's cleaner follows the driver's garbage collection, which a driver with little to do seldom runs
    jvm.System.gc()


#: At most so many keys hold more than this share of all rows each.
HOT_KEYS = 1000


def join_groups(rows: DataFrame, groups: DataFrame, key: str, total: int, salt: Column) -> DataFrame:
    """``rows`` with the columns of ``groups``, one row a key with its number of rows ``__rows``.

    A key with over a thousandth of all ``total`` rows is hot: there are fewer than
    ``HOT_KEYS``, so these are broadcast, and their rows are dealt by ``salt`` where
    the others are dealt by key.  (A constant in its place would be folded away, and
    all rows dealt by key.)  Keys are not null.
    """
    values = [c for c in groups.columns if c not in (key, "__rows")]
    is_hot = F.col("__rows") * HOT_KEYS > total
    hot = groups.where(is_hot).select(F.col(key).alias("__hot_key"), *[F.col(c).alias(f"__hot_{k}") for k, c in enumerate(values)])
    cold = groups.where(~is_hot).select(F.col(key).alias("__cold_key"), F.xxhash64(key).alias("__cold_salt"), *[F.col(c).alias(f"__cold_{k}") for k, c in enumerate(values)])
    met = rows.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn("__salt", F.when(F.col("__hot_key").isNotNull(), F.xxhash64(salt)).otherwise(F.xxhash64(key)))
    joined = met.join(cold, (F.col(key) == F.col("__cold_key")) & (F.col("__salt") == F.col("__cold_salt")), "left")
    return joined.select(*rows.columns, *[F.coalesce(f"__hot_{k}", f"__cold_{k}").alias(c) for k, c in enumerate(values)])


def join_dealt(rows: DataFrame, side: DataFrame, key: str, counts: DataFrame, total: int, salt: Column) -> DataFrame:
    """Inner join of ``rows`` with ``side`` (one row a key), where a key may hold most of ``rows``.

    ``counts`` has ``__rows``, the number of ``rows`` of each key; ``total`` is their sum.
    The rows of a key with over a thousandth of all are dealt by ``salt``, and that
    key's row of ``side`` is copied to each share: at most twice ``HOT_KEYS`` copies in all.
    """
    shares = F.ceil(F.col("__rows") * HOT_KEYS / max(1, total)).cast("int")
    hot = counts.where(F.col("__rows") * HOT_KEYS > total).select(F.col(key).alias("__hot_key"), shares.alias("__shares"))
    marked = [df.join(F.broadcast(hot), F.col(key) == F.col("__hot_key"), "left").withColumn("__shares", F.coalesce("__shares", F.lit(1))) for df in (rows, side)]
    left = marked[0].withColumn("__share", F.pmod(F.xxhash64(salt), F.col("__shares")).cast("int")).drop("__hot_key", "__shares")
    right = marked[1].withColumn("__share", F.explode(F.sequence(F.lit(0), F.col("__shares") - 1))).drop("__hot_key", "__shares")
    return left.join(right, [key, "__share"]).drop("__share")


class Remembered(dict):
    """Values by key, made by ``fresh`` when they are first asked for and kept up to a bound of bytes.

    When it is full, it becomes the older one, and what is met again moves on from there.
    Very large entries are not kept.
    """

    #: Bytes of an entry besides the length of its key and value, about.
    ENTRY = 240

    def __init__(self, most_bytes: int):
        super().__init__()
        self.most, self.held, self.older = most_bytes, 0, {}

    def fresh(self, key):
        raise NotImplementedError

    def length(self, key, value) -> int:
        return len(key) + len(value)

    def __missing__(self, key):
        found = self.older.get(key)
        if found is None:
            found = self.fresh(key)
        size = self.ENTRY + self.length(key, found)
        if size * 1000 <= self.most:
            if self.held + size > self.most:
                self.older, self.held = dict(self), 0
                self.clear()
            self[key] = found
            self.held += size
        return found


def byte_characters() -> list[str]:
    """The visible character that stands for each byte: printable Latin-1 for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(other)) for b in range(256)]


def crc_remainder(id_col: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus`` (null for a null id)."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))
