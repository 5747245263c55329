"""Incremental sync: changed records flow into a served table, bad ones into a dead-letter table.

Both run on Structured Streaming with ``availableNow``: offsets are in the
checkpoint, every batch is an upsert by key, so a batch that is repeated after a
failure changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from citeloom.operators.store import Store, upserted

# Class of an error, how bad it is, and whether trying again may help.
ERROR_CLASSES = [
    ("ConnectionError", "connection", "high", True), ("ConnectionTimeout", "timeout", "medium", True), ("RequestError", "indexing", "medium", True), ("ConflictError", "indexing", "low", True),
    ("AuthenticationException", "authentication", "critical", False), ("AuthorizationException", "authorization", "critical", False), ("SerializationError", "serialization", "medium", False), ("PyMongoError", "connection", "high", True),
]
MOST_ATTEMPTS = 5


def changed_since(df: DataFrame, since: Column, at: str = "updated_at") -> DataFrame:
    """FIL20, STM08: rows changed at or after ``since``; the condition reaches the scan."""
    return df.where(F.col(at) >= since)


def document_hash(df: DataFrame, leave_out: tuple[str, ...] = ("_id", "created_at", "updated_at")) -> Column:
    """HSH01: a hash of all other columns, in order of their names."""
    cols = sorted(c for c in df.columns if c not in leave_out)
    return F.sha2(F.to_json(F.struct(*[F.col(f"`{c}`") for c in cols]), {"ignoreNullFields": "false"}), 256)


def snapshot_diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """STM12: ``key, change`` (inserted, updated, deleted) between two snapshots, by hash. Rows without change don't come out."""
    o, n = old.select(key, document_hash(old).alias("_old")), new.select(key, document_hash(new).alias("_new"))
    both = o.join(n, key, "full")
    change = F.when(F.col("_old").isNull(), "inserted").when(F.col("_new").isNull(), "deleted").when(F.col("_old") != F.col("_new"), "updated")
    return both.select(key, change.alias("change")).where("change is not null")


def resolved(source: DataFrame, target: DataFrame, key: str, at: str, manual: bool = False) -> DataFrame:
    """JOI22: for keys of both, who wins: the source where it is newer; nobody where it is left to hand."""
    s, t = source.select(key, F.col(at).alias("_s")), target.select(key, F.col(at).alias("_t"))
    win = F.lit("unresolved") if manual else F.when(F.col("_s") > F.col("_t"), "source").otherwise("target")
    return s.join(t, key).select(key, win.alias("winner"))


def consistency(source: DataFrame, target: DataFrame, tolerance: int = 5) -> DataFrame:
    """AGG27: both counts, and whether they differ by no more than ``tolerance``."""
    both = source.agg(F.count(F.lit(1)).alias("n_source")).crossJoin(target.agg(F.count(F.lit(1)).alias("n_target")))  # one row each
    diff = F.abs(F.col("n_source") - F.col("n_target"))
    return both.select("n_source", "n_target", diff.alias("difference"), (diff <= tolerance).alias("is_consistent"))


def classified(errors: DataFrame, name: str = "error_class") -> DataFrame:
    """STM15: with type, severity and whether it can be tried again; unknown ones are medium and can."""
    rows = errors.sparkSession.createDataFrame(ERROR_CLASSES, "_name string, error_type string, severity string, recoverable boolean")
    got = errors.join(F.broadcast(rows), F.col(name) == F.col("_name"), "left").drop("_name")  # eight rows
    return got.fillna({"error_type": "unknown", "severity": "medium", "recoverable": True})


class Sync:
    """STM01-04, STM07-11, SNK09, SNK19, SNK20: a stream of JSON or parquet files into a keyed table.

    ``valid`` says which rows are served; the others go to ``dead_letter`` with an
    error and a count of attempts. ``transform`` makes served rows of read ones.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str, at: str, valid: Column, transform: Callable[[DataFrame], DataFrame] = lambda df: df):
        self.spark, self.key, self.at, self.valid, self.transform = spark, key, at, valid, transform
        self.served = Store(spark, f"{folder}/served", [key])
        self.dead = Store(spark, f"{folder}/dead_letter", [key])
        self.log = f"{folder}/log"
        self.checkpoint = f"{folder}/checkpoint"

    def apply(self, batch: DataFrame, n: int) -> None:
        """One batch: newest row of each key is upserted if it isn't older than the served one."""
        ok = F.coalesce(self.valid, F.lit(False))
        good, bad = self._newer(self.transform(batch.where(ok))), batch.where(~ok)
        n_good, n_bad = good.count(), bad.count()
        if n_good:
            self.served.upsert(good, self.at)
        if n_bad:
            rows = bad.select(F.coalesce(F.col(self.key).cast("string"), F.lit("")).alias(self.key), F.to_json(F.struct("*")).alias("document"), F.lit("serialization").alias("error_type"), F.lit("medium").alias("severity"), F.lit(1).alias("attempts"), F.lit(n).alias("batch"))
            self.dead.upsert(rows)
        entry = self.spark.createDataFrame([(n, n_good, n_bad)], "batch long, n_served long, n_failed long").withColumn("status", F.when(F.col("n_failed") == 0, "success").when(F.col("n_served") > 0, "partial").otherwise("failed"))
        entry.write.mode("append").parquet(self.log)

    def _newer(self, rows: DataFrame) -> DataFrame:
        """Without rows older than the served row of their key."""
        old = self.served.read()
        if old is None or self.at not in rows.columns:
            return rows
        served = old.select(self.key, F.col(self.at).alias("_old"))
        return rows.join(served, self.key, "left").where(F.col("_old").isNull() | (F.col(self.at) >= F.col("_old"))).drop("_old")

    def run(self, path: str, schema: T.StructType, source: str = "parquet", files_per_batch: int = 1000) -> None:
        """STM10, SRC20: everything that came since the last run, then stop."""
        stream = self.spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).format(source).load(path)
        query = stream.writeStream.option("checkpointLocation", self.checkpoint).trigger(availableNow=True).foreachBatch(self.apply).start()
        query.awaitTermination()

    def retry(self, again: Callable[[DataFrame], DataFrame], schema: T.StructType) -> tuple[int, int]:
        """STM14: dead letters of under five attempts once more: (now good, failed again). ``again`` mends rows;
        one that is older than the served row of its key is done with, but isn't served."""
        dead = self.dead.read()
        if dead is None:
            return 0, 0
        tried = again(dead.where(F.col("attempts") < MOST_ATTEMPTS).select(F.col(self.key).alias("_dead"), F.from_json("document", schema).alias("d")).select("_dead", "d.*"))
        ok = F.coalesce(self.valid, F.lit(False))
        good = tried.where(ok)
        n = good.count()
        newer = self._newer(self.transform(good.drop("_dead")))
        if n and not newer.isEmpty():
            self.served.upsert(newer, self.at)
        left = dead.join(good.select(F.col("_dead").alias(self.key)).distinct(), self.key, "left_anti").withColumn("attempts", F.when(F.col("attempts") < MOST_ATTEMPTS, F.col("attempts") + 1).otherwise(F.col("attempts")))
        failed = left.count()
        self.dead.write(left)
        return n, failed

    def status(self) -> DataFrame:
        """STM11, SNK20, WIN03: runs so far, rows, and the last status."""
        return self.spark.read.parquet(self.log).agg(F.count(F.lit(1)).alias("n_batches"), F.sum("n_served").alias("n_served"), F.sum("n_failed").alias("n_failed"), F.max_by("status", "batch").alias("last_status"))


def dead_letter_list(dead: DataFrame, error_type: str | None = None, limit: int | None = 100) -> DataFrame:
    """FIL27: newest first; all of them in no order if ``limit`` is None."""
    rows = dead if error_type is None else dead.where(F.col("error_type") == error_type)
    return rows if limit is None else rows.orderBy(F.desc("batch")).limit(limit)


class Reindex:
    """STM13, SNK11, SNK18, AGG28: a new version of a served table behind a view, swapped only if it holds enough rows."""

    def __init__(self, spark: SparkSession, alias: str, folder: str, least: float = 0.95):
        self.spark, self.alias, self.folder, self.least = spark, alias, folder, least

    def run(self, source: DataFrame, key: str, version: str) -> DataFrame:
        """Writes ``source`` (one row per key), checks its count against the source's, then swaps the view.

        A failed check leaves the view as it is. The result is one row with both
        counts, the share and what became of it.
        """
        target = f"{self.folder}/{version}"
        rows = source.where(F.col(key).isNotNull())
        upserted(None, rows, [key]).write.parquet(target)
        n_source, n_target = source.select(key).distinct().count(), self.spark.read.parquet(target).count()
        share = n_target / n_source if n_source else 1.0
        done = share >= self.least
        if done:
            self.spark.read.parquet(target).createOrReplaceTempView(self.alias)
        return self.spark.createDataFrame([(version, n_source, n_target, share, "swapped" if done else "rolled back")], "version string, n_source long, n_target long, share double, outcome string")


def windowed_counts(events: DataFrame, at: str, kind: str, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Extension: event-time counts with a watermark; the same on a stream and on a table."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late).groupBy(F.window(at, window), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("window_start"), kind, "n")


def deduplicated(stream: DataFrame, key: str, at: str, late: str = "2 hours") -> DataFrame:
    """STM16: the first of each key within the watermark."""
    return stream.withWatermark(at, late).dropDuplicatesWithinWatermark([key])
