"""Readers and writers at the edge of the library."""

from __future__ import annotations

import json
import os
import tempfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fieldstate.functions import names as N


def read_csv_table(spark: SparkSession, path: str | list[str], schema: T.StructType) -> DataFrame:
    """CSV with header and explicit types; ``NA`` is missing, a malformed row fails the job."""
    return spark.read.schema(schema).csv(path, header=True, nullValue="NA", mode="FAILFAST", enforceSchema=False)


def write_csv_table(df: DataFrame, path: str) -> None:
    df.write.mode("errorifexists").csv(path, header=True, nullValue="NA")


def write_table(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("year",)) -> None:
    """Parquet for hand-over between stages. Partition by year or category, never by site (small files)."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A table of :func:`write_table`. Filters on its partition columns prune whole folders before any file is opened."""
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only a local session without one gets a folder of its own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        named = tempfile.mkdtemp(prefix="fieldstate-")
        spark.sparkContext.setCheckpointDir(named)
    return str(named).rstrip("/")


def _without_preamble(spark: SparkSession, paths: str | list[str], skip: int) -> DataFrame:
    """(source, header, line): all lines after the header line of each file, which may be split over many tasks.

    Lines of a task are numbered in the order in which they are read, and a file's first split says that it starts at 0. So
    the first ``skip + 1`` numbers of that split are the preamble and the header; the rank filter keeps no more than these per
    task before the small shuffle. The preamble must lie in a file's first split.
    """
    lines = spark.read.text(paths).select(
        F.col("_metadata.file_path").alias("source"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("number"), F.regexp_replace("value", r"\r$", "").alias("line"),
    )
    rank = F.row_number().over(Window.partitionBy("source").orderBy("number"))
    first = lines.filter("block = 0").withColumn("rank", rank).filter(F.col("rank") <= skip + 1)
    heads = first.filter(F.col("rank") == skip + 1).select("source", F.split("line", ",").alias("header"), F.col("number").alias("head"))
    return lines.join(heads, "source").filter("block > 0 OR number > head").select("source", "header", "line")


def read_skip_header(spark: SparkSession, paths: str | list[str], skip: int, schema: T.StructType) -> DataFrame:
    """CSV files that start with ``skip`` preamble lines and then a header line; all files united.

    Columns are taken by header name, so files may hold more columns, or the same ones in another order. Files of any size:
    their splits are read in parallel. A value may be quoted but holds no line end; empty lines and files that end before their
    header give no rows.
    """
    body = _without_preamble(spark, paths, skip).filter(F.trim("line") != "")
    fields = F.transform(F.split("line", r',(?=(?:[^"]*"[^"]*")*[^"]*$)', -1), lambda c: F.trim(F.btrim(c, F.lit('"'))))
    header = F.transform("header", lambda c: F.trim(F.btrim(c, F.lit('"'))))
    row = body.select("source", header.alias("header"), fields.alias("fields"))

    def cell(field: T.StructField):
        position = F.array_position("header", field.name)
        raw = F.get("fields", (position - 1).cast("int"))
        present = (position > 0) & (raw != "") & (raw != "NA")
        return F.when(present, raw).cast(field.dataType).alias(field.name)

    return row.select(*[cell(f) for f in schema.fields], "source")


class ImageFolders(DataSource):
    """Names of the files below folders: a Spark data source with one partition per folder.

    Folders are listed where the partition runs, one directory at a time, so neither names nor file statuses pass the driver.
    Options: ``folders`` (JSON list), ``pattern``.
    """

    @classmethod
    def name(cls) -> str:
        return "image_folders"

    def schema(self) -> str:
        return "filepath string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _FolderReader(json.loads(self.options["folders"]), self.options["pattern"])


class _FolderReader(DataSourceReader):
    def __init__(self, folders: list[str], pattern: str):
        self.folders, self.pattern = folders, pattern

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.folders]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        from fnmatch import fnmatchcase

        from pyarrow import fs

        folder = partition.value
        system, root = fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
        scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else "file:"
        waiting = [root]
        while waiting:
            names = []
            for info in system.get_file_info(fs.FileSelector(waiting.pop())):
                if info.base_name[:1] in "._":
                    continue
                if info.type == fs.FileType.Directory:
                    waiting.append(info.path)
                elif fnmatchcase(info.base_name, self.pattern):
                    names.append(scheme + info.path)
            if names:
                yield pa.record_batch([pa.array(names, pa.string())], ["filepath"])


def list_images(spark: SparkSession, dirs: list[str], pattern: str = "*.jpg") -> DataFrame:
    """All image files below several folders: (filepath, file). File contents are not read; see :class:`ImageFolders`.

    Hidden names (``.`` or ``_`` first) are left out. A folder is one task, so give the folders of the sites, not their parent.
    """
    spark.dataSource.register(ImageFolders)
    files = spark.read.format("image_folders").option("folders", json.dumps(list(dirs))).option("pattern", pattern).load()
    return files.withColumn("file", N.base_name("filepath"))
