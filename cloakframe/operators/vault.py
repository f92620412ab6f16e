"""Reversible tokens: a table of value and token pairs with a time to live.

A token is drawn once for a value, written, and read back before it's joined, so that a task that
runs again can't draw another. One live token for each value and category. Beyond the capacity the
newest pairs are live. Pairs lie in generations, with one writer at a time; evict writes the live
ones as the next generation and deletes the others, plain values with them.
"""

from __future__ import annotations

from datetime import UTC, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TTL_SECONDS = 15 * 60
CAPACITY = 10_000_000
TOKEN_BYTES = 12
SCHEMA = "category string, value string, token string, created_at timestamp, expires_at timestamp"


class Vault:
    """Token pairs below a path that driver and executors share."""

    def __init__(self, spark: SparkSession, path: str, ttl_seconds: int = TTL_SECONDS, capacity: int = CAPACITY):
        if ttl_seconds < 1 or capacity < 1:
            raise ValueError("time to live and capacity must be 1 or more")
        self.spark, self.path, self.ttl, self.capacity = spark, path.rstrip("/"), ttl_seconds, capacity
        self.generation = max(self._generations(), default=0)
        if not self._generations():
            spark.createDataFrame([], SCHEMA).write.parquet(self._folder(0))

    def _generations(self) -> list[int]:
        """Those that were written to the end."""
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [x.getPath().getName() for x in fs.listStatus(root)] if fs.exists(root) else []
        done = lambda n: fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{n}/_SUCCESS"))
        return [int(n.split("-")[1]) for n in names if n.startswith("pairs-") and done(n)]

    def _folder(self, generation: int) -> str:
        return f"{self.path}/pairs-{generation}"

    def _pairs(self, at: datetime) -> DataFrame:
        found = self.spark.read.schema(SCHEMA).parquet(self._folder(self.generation)).filter(F.col("expires_at") > F.lit(at))
        return found.orderBy(F.desc("created_at"), "token").limit(self.capacity) if found.count() > self.capacity else found

    def live(self) -> DataFrame:
        """The pairs whose time isn't over, as of now."""
        return self._pairs(datetime.now(UTC))

    def tokenize(self, df: DataFrame, column: str, category: str = "UNSPECIFIED") -> DataFrame:
        """df with the column's values replaced by their tokens; null stays null.

        The pairs are those of the call's moment: a time to live that ends meanwhile takes no token away.
        """
        at = datetime.now(UTC)
        own = lambda: self.spark.read.schema(SCHEMA).parquet(self._folder(self.generation)).filter((F.col("expires_at") > F.lit(at)) & (F.col("category") == category))
        new = df.select(F.col(f"`{column}`").alias("value")).filter("value is not null").distinct().join(own().select("value"), "value", "left_anti")
        # uuid() is drawn from the system's random source; its hash has more bytes than a token.
        raw = F.substring(F.unhex(F.sha2(F.concat(F.expr("uuid()"), F.expr("uuid()")), 256)), 1, TOKEN_BYTES)
        token = F.concat(F.lit(f"tok_{category.lower()}_"), F.translate(F.base64(raw), "+/=", "-_"))
        rows = new.select(F.lit(category).alias("category"), "value", token.alias("token"), F.lit(at).alias("created_at"), F.lit(at + timedelta(seconds=self.ttl)).alias("expires_at"))
        rows.write.mode("append").parquet(self._folder(self.generation))
        pairs = own().groupBy("value").agg(F.min_by("token", F.struct("created_at", "token")).alias("__token"))
        joined = df.join(pairs.withColumnRenamed("value", "__value"), F.col(f"`{column}`") == F.col("__value"), "left")
        return joined.withColumn(column, F.col("__token")).drop("__value", "__token")

    def detokenize(self, df: DataFrame, column: str, into: str = "value") -> DataFrame:
        """df with the tokens' values; unknown and expired tokens give null."""
        pairs = self.live().select(F.col("token").alias("__token"), F.col("value").alias("__found"))
        return df.join(pairs, F.col(f"`{column}`") == F.col("__token"), "left").withColumn(into, F.col("__found")).drop("__token", "__found")

    def evict(self) -> int:
        """Deletes all pairs that aren't live from disk, and gives how many stay.

        Frames that tokenize and detokenize gave before read what goes: call it when they have run.
        """
        self.live().write.mode("overwrite").parquet(self._folder(self.generation + 1))
        gone, self.generation = self._generations(), self.generation + 1
        for n in gone:
            if n < self.generation:
                path = self.spark._jvm.org.apache.hadoop.fs.Path(self._folder(n))
                path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        return self.spark.read.parquet(self._folder(self.generation)).count()
