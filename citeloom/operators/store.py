"""Keyed tables without a table format: parts in folders, of which versions are made up.

A table is cut into parts by a hash of its key. A version is a small file that
names the folder of each part; a change writes the parts that its keys fall into
and then puts such a file beside the old ones, so readers see the one version or
the other, and a job that dies leaves the old. Plain Spark tables
refuse MERGE and UPDATE; with a table format that has them, ``mergeInto`` does the
same in place.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.versions import latest_version


@dataclass
class Store:
    """A keyed table at ``path``, in ``buckets`` parts by a hash of the key."""

    spark: SparkSession
    path: str
    key: list[str]
    buckets: int = 16

    def _fs(self):  # noqa: ANN202
        jvm = self.spark._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[str]:
        jvm, fs, p = self._fs()
        mark = jvm.org.apache.hadoop.fs.Path(p, "_current")
        return sorted(f.getPath().getName() for f in fs.listStatus(mark)) if fs.exists(mark) else []

    def current(self) -> dict[int, str] | None:
        """The folder of each part in the current version, -1 for an empty table's; None for a new table."""
        names = self._manifests()
        if not names:
            return None
        jvm, fs, p = self._fs()
        stream = fs.open(jvm.org.apache.hadoop.fs.Path(p, f"_current/{names[-1]}"))
        try:
            return {int(k): v for k, v in json.loads(bytes(stream.readAllBytes()).decode()).items()}
        finally:
            stream.close()

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in self.key]), F.lit(self.buckets)).cast("int")

    def _parts(self, folders: dict[int, str], wanted: set[int] | None = None) -> DataFrame | None:
        # an empty part has the columns, so that a version without rows has them too
        at = [f for b, f in folders.items() if wanted is None or b in wanted or b == -1]
        return self.spark.read.option("mergeSchema", True).parquet(*at) if at else None

    def read(self) -> DataFrame | None:
        now = self.current()
        return None if now is None else self._parts(now)

    def touched(self, rows: DataFrame) -> set[int]:
        """The parts that hold the keys of ``rows``; no more than there are parts."""
        return {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}

    def write(self, df: DataFrame, touched: set[int] | None = None) -> str:
        """CTL11: a new version becomes the current one; returns its folder. With ``touched``, ``df`` has
        all rows of those parts, and the others stay where they are."""
        jvm, fs, p = self._fs()
        names = self._manifests()
        n = int(names[-1].split("=")[0]) + 1 if names else 1
        folder = f"{self.path}/v{n:06d}-{uuid.uuid4().hex[:8]}"
        df.withColumn("_bucket", self._bucket()).write.partitionBy("_bucket").parquet(folder)
        made = [f.getPath().getName() for f in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if f.isDirectory()]
        new = {int(d.split("=")[1]): f"{folder}/{d}" for d in made if d.startswith("_bucket=")}
        stay = {} if touched is None else {b: f for b, f in (self.current() or {}).items() if b not in touched and b >= 0}
        parts = stay | new
        if not parts:
            df.limit(0).coalesce(1).write.parquet(f"{folder}/empty")
            parts = {-1: f"{folder}/empty"}
        mark = jvm.org.apache.hadoop.fs.Path(p, "_current")
        fs.mkdirs(mark)
        name = f"{n:06d}={folder.rsplit('/', 1)[1]}"
        draft, final = jvm.org.apache.hadoop.fs.Path(p, f"_draft-{uuid.uuid4().hex}"), jvm.org.apache.hadoop.fs.Path(mark, name)
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(parts).encode()))
        out.close()
        if any(int(x.split("=")[0]) >= n for x in self._manifests()) or not fs.rename(draft, final):  # another writer was first
            raise FileExistsError(f"version {n} of {self.path}")
        return folder

    def upsert(self, new: DataFrame, version: str | None = None) -> str:
        """SNK01, SNK05, SNK10, SNK17: rows replace those of their key, others stay; only parts that hold such keys are read and written."""
        now = self.current() or {}
        touched = self.touched(new)
        return self.write(upserted(self._parts(now, touched), new, self.key, version), touched)

    def append(self, new: DataFrame) -> str:
        """SNK02-04: adds rows; fails if a key is there already or comes twice."""
        touched = self.touched(new)
        old = self._parts(self.current() or {}, touched)
        keyed = new.groupBy(*self.key).agg(F.count(F.lit(1)).alias("n"))
        if not keyed.where("n > 1").isEmpty() or old is not None and not keyed.join(old, self.key, "left_semi").isEmpty():
            raise ValueError(f"a key of {self.key} is there already")
        return self.write(new if old is None else old.unionByName(new, allowMissingColumns=True), touched)

    def delete(self, keys: DataFrame) -> int:
        """SNK07, STM12: takes out the rows of ``keys``; how many there were."""
        now = self.current()
        if now is None:
            return 0
        gone = keys.select(*self.key).distinct()
        touched = self.touched(gone)
        old = self._parts(now, touched)
        n = old.join(gone, self.key, "left_semi").count() if old is not None else 0
        if n:
            self.write(old.join(gone, self.key, "left_anti"), touched)
        return n

    def retain(self, at: str, as_of: Column, days: int = 90) -> int:
        """SNK08: takes out rows from before the last ``days``; how many there were."""
        if days < 1:
            raise ValueError("days must be 1 or more")
        old = self.read()
        if old is None:
            return 0
        keep = F.col(at) >= as_of - F.make_dt_interval(F.lit(days))
        gone = old.where(~keep)
        touched = self.touched(gone)
        if not touched:
            return 0
        n = gone.count()
        self.write(self._parts(self.current(), touched).where(F.coalesce(keep, F.lit(True))), touched)
        return n


def upserted(old: DataFrame | None, new: DataFrame, key: list[str], version: str | None = None) -> DataFrame:
    """Old rows whose key isn't among the new, and the latest new row of each key."""
    k = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in key])
    order = F.col(version) if version else F.lit(None).cast("timestamp")
    last = latest_version(new, k, order, new.columns).drop("_key")
    if old is None:
        return last
    return old.join(last.select(*key), key, "left_anti").select(*old.columns).unionByName(last, allowMissingColumns=True)


def patched(old: DataFrame, changes: DataFrame, key: list[str]) -> DataFrame:
    """SNK05, SNK06: fields that ``changes`` gives (not null) replace those of its key; rows without changes stay."""
    fields = [c for c in changes.columns if c not in key]
    c = changes.select(*key, *[F.col(f).alias(f"_new_{f}") for f in fields])
    got = old.join(c, key, "left")
    return got.select(*[F.coalesce(F.col(f"_new_{f}"), F.col(f)).alias(f) if f in fields else F.col(f) for f in old.columns])


def matching(df: DataFrame, *, equal: dict[str, object] | None = None, among: dict[str, list] | None = None, between: dict[str, tuple] | None = None, tags: list[str] | None = None, sort_by: str = "created_at", ascending: bool = False, skip: int = 0, limit: int | None = 100, key: str = "analysis_id") -> DataFrame:
    """FIL13, FIL14, SRT05, SRT07: all given conditions at once, then sorted (equal ones by key), skipped and cut."""
    c = F.lit(True)
    for name, v in (equal or {}).items():
        c = c & F.col(name).eqNullSafe(F.lit(v))
    for name, vs in (among or {}).items():
        c = c & F.col(name).isin(*vs)
    for name, (low, high) in (between or {}).items():
        c = c & (F.lit(True) if low is None else F.col(name) >= F.lit(low)) & (F.lit(True) if high is None else F.col(name) <= F.lit(high))
    if tags:
        c = c & F.arrays_overlap("tags", F.array(*[F.lit(t) for t in tags]))
    out = df.where(c).orderBy(F.asc(sort_by) if ascending else F.desc(sort_by), key)
    out = out.offset(skip) if skip else out
    return out.limit(limit) if limit is not None else out


def merge_sql(table: str, source: str, key: list[str]) -> str:
    """The upsert as MERGE, for table formats that have it."""
    on = " AND ".join(f"t.{k} <=> s.{k}" for k in key)
    return f"MERGE INTO {table} t USING {source} s ON {on} WHEN MATCHED THEN UPDATE SET * WHEN NOT MATCHED THEN INSERT *"
