"""A folder of payload files (UD1), named source-keyword.json or .xml.

``payload_files`` reads it from any file system that Spark knows. ``PayloadSource`` is the same as a data source of
one partition per file, for folders that every machine has mounted at the same path:

    spark.dataSource.register(PayloadSource)
    spark.read.format("payloads").load(folder)
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "keyword string, source string, payload string"


def payload_files(spark: SparkSession, folder: str) -> DataFrame:
    """(keyword, source, payload) of the files of a folder, wherever it lies."""
    rows = spark.read.option("pathGlobFilter", "*.{json,xml}").text(folder, wholetext=True).select(F.col("value").alias("payload"), F.url_decode(F.input_file_name()).alias("path"))
    stem = F.regexp_extract("path", r"([^/]+)\.(?:json|xml)$", 1)
    return rows.select(F.nullif(F.regexp_extract(stem, r"^[^-]*-(.*)$", 1), F.lit("")).alias("keyword"), F.regexp_extract(stem, r"^([^-]*)", 1).alias("source"), "payload")


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[InputPartition]:
        names = sorted(n for n in os.listdir(self.folder) if n.endswith((".json", ".xml")))
        return [_File(os.path.join(self.folder, n)) for n in names]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        stem = os.path.splitext(os.path.basename(partition.path))[0]
        source, _, keyword = stem.partition("-")
        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield keyword or None, source, f.read()


class PayloadSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])
