"""What the corpus operators share: tables, the shared folder, folds and batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakframe.ship import ship

#: Largest Arrow batch that goes to a Python worker, so that long texts don't gather there.
ARROW_BATCH_BYTES = 8 << 20


def prepare(spark: SparkSession) -> None:
    """Ships the package and bounds the Arrow batches by bytes."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent a temporary folder is set if all runs in this one process, as in
    tests; RuntimeError on a cluster, whose executors couldn't read it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = f"file://{tempfile.mkdtemp(prefix='cloakframe-')}"
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/cloakframe/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex[:12]}"


#: Shuffles go with the write that made them, and rows needn't be sorted for a few partitions.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.maxConcurrentOutputFileWriters": "4"}


def stored(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts its lineage.

    The shuffles of that write end with it, as nothing else can use them.
    """
    spark = df.sparkSession
    path = shared_dir(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = {k: spark.conf.get(k, None) for k in _WRITING}
    try:
        for k, v in _WRITING.items():
            spark.conf.set(k, v)
        writer.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    back = spark.read.schema(df.schema).parquet(path)
    back.stored_at = path
    return back


def discard(*frames: DataFrame) -> None:
    """Deletes what stored wrote; only for frames that nothing reads any more."""
    for df in frames:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(df.stored_at)
        path.getFileSystem(conf).delete(path, True)


#: A key is hot if it has more than this part of all rows, so there are fewer than HOT_KEYS of them.
HOT_KEYS = 1000


def hot_join(rows: DataFrame, facts: DataFrame, key: str) -> DataFrame:
    """rows joined with facts (one row for each key), however many rows a key has.

    Hot keys are fewer than HOT_KEYS, so their facts go to all tasks; only the others are dealt by key.
    """
    least = rows.count() // HOT_KEYS
    sizes = rows.groupBy(key).agg(F.count("*").alias("rows_of_key"))
    hot = stored(sizes.filter(F.col("rows_of_key") > least).orderBy(F.desc("rows_of_key")).limit(HOT_KEYS).select(key), "hot")
    own = F.broadcast(facts.join(F.broadcast(hot), key, "left_semi"))
    return rows.join(F.broadcast(hot), key, "left_anti").join(facts, key).unionByName(rows.join(own, key))


def unused(df: DataFrame, name: str) -> str:
    """A column name that df hasn't got, like name."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def fold(key: str | Column, n: int) -> Column:
    """crc32 of the key as text, modulo n; a null key counts as remainder -1, in no fold."""
    key = F.col(key) if isinstance(key, str) else key
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % n, F.lit(-1))


def by_bytes(texts: list, limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """Bounds of runs of texts with about limit characters each; a longer text stands alone."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text is not None else 0
        if i > start and size + n > limit:
            yield start, i
            start, size = i, 0
        size += n
    if start < len(texts):
        yield start, len(texts)
