"""Readers and writers of registries, documents and offline results."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

REGISTRY = "dataset_id string, dataset_name string, group_name string, aliases string"
PAIRS = "publication_id string, publication_title string, publication_doi string, validated_dataset_id string, validated_dataset_name string, is_mentioned boolean, is_used boolean, validation_reasoning string, confidence_score_mention double, confidence_score_use double"
DISCOVERED = "publication_id string, publication_title string, publication_doi string, new_name string, new_is_mentioned boolean, new_is_used boolean, new_description string, new_source string, new_domain string, new_confidence_score_mention double, new_confidence_score_use double"


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """SRC01-03: a CSV with header, quoted line ends and doubled quotes; an empty table where the file lacks."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], schema)
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').schema(schema).csv(path)


@F.pandas_udf(T.StringType())
def _indented(documents: pd.Series) -> pd.Series:
    return documents.map(lambda d: json.dumps(json.loads(d), indent=2, ensure_ascii=False))


def write_documents(docs: DataFrame, folder: str) -> int:
    """SNK13, SNK14: one file ``<slug>.jsonld`` per row of ``slug, document``; how many.

    Tasks write the files through the session's file system, the driver only gives
    them their names. Slugs must be distinct: see ``catalog.slug_clashes``.
    """
    spark = docs.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path
    made = path(f"{folder}/_documents-{uuid.uuid4().hex}")
    docs.select(F.coalesce("slug", F.lit("")).alias("slug"), _indented("document").alias("value")).write.partitionBy("slug").text(made.toString())
    fs, n = made.getFileSystem(spark._jsc.hadoopConfiguration()), 0
    for d in fs.listStatus(made):
        name = d.getPath().getName()
        if not d.isDirectory() or not name.startswith("slug="):
            continue
        slug = name.removeprefix("slug=").replace("__HIVE_DEFAULT_PARTITION__", "")
        for f in fs.listStatus(d.getPath()):
            target = path(f"{folder}/{slug}.jsonld")
            fs.delete(target, False)
            fs.rename(f.getPath(), target)
            n += 1
    fs.delete(made, True)
    return n


def write_json_lines(df: DataFrame, path: str) -> None:
    """SNK14, SNK15: rows as JSON lines, appended, for the next stage to read as a stream."""
    df.select(F.to_json(F.struct("*")).alias("value")).write.mode("append").text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """SRC19: ``repo, path, length, content`` of every file in the zip archives of a folder."""
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io
        import zipfile

        for b in batches:
            rows = []
            for p, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        rows += [(Path(p).stem, i.filename, i.file_size, z.read(i).decode("utf-8", "replace")) for i in z.infolist() if not i.is_dir()]
                except zipfile.BadZipFile:
                    continue
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.string())], names=["repo", "path", "length", "content"])

    return archives.mapInArrow(unzip, "repo string, path string, length long, content string")


class PagedSearch(DataSource):
    """SRC09, SRC11: a search service as a data source: one partition per year, pages followed by cursor.

    ``pages`` is the folder of its answers (``<year>/<n>.json``, a list of rows and
    the next cursor), a path or the address of a file system that all executors
    reach; a live service needs only another ``fetch``.
    """

    @classmethod
    def name(cls) -> str:
        return "citeloom_search"

    def schema(self) -> str:
        return "id string, title string, year int, document string"

    def reader(self, schema: object) -> DataSourceReader:
        return PagedReader(self.options)


class Year(InputPartition):
    def __init__(self, year: int):
        self.year = year


class PagedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder, self.start, self.end = options["pages"], int(options["start_year"]), int(options["end_year"])

    def partitions(self) -> list[Year]:
        return [Year(y) for y in range(self.start, self.end + 1)]

    def fetch(self, year: int, cursor: str) -> dict:
        system, folder = pa.fs.FileSystem.from_uri(self.folder)
        at = f"{folder}/{year}/{cursor}.json"
        if system.get_file_info(at).type == pa.fs.FileType.NotFound:
            return {"rows": [], "next": None}
        with system.open_input_stream(at) as f:
            return json.loads(f.read())

    def read(self, partition: Year) -> Iterator[tuple]:
        cursor: str | None = "0"
        while cursor is not None:
            page = self.fetch(partition.year, cursor)
            for r in page["rows"]:
                yield r.get("id"), r.get("title"), partition.year, json.dumps(r)
            cursor = page.get("next")
