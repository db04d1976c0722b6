"""Files as tables: libraries, texts, summaries, trackers and settings (SC1-SC8, SC35-SC46)."""

from __future__ import annotations

import io
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, fields

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = (
    "title string, authors string, year string, doi string, source string, url string, citation_key string, pdf_path string, added_date string, abstract string, venue string, "
    "citation_count string, metadata string"
)


def _text_list(c: Column) -> Column:
    """A list of strings from a JSON list or a single value; null and empty give an empty list."""
    many = F.from_json(c, "array<string>")
    return F.when(c.isNull() | (c == ""), F.array().cast("array<string>")).when(c.startswith("["), F.coalesce(many, F.array().cast("array<string>"))).otherwise(F.array(c))


def coerce_entries(rows: DataFrame) -> DataFrame:
    """SC2: typed rows from raw ones: defaults, single values as lists, lists of venues joined."""
    number = lambda c: F.regexp_extract(F.coalesce(F.col(c), F.lit("")), r"^-?\d+", 0)
    venue = _text_list(F.col("venue"))
    return rows.select(
        F.coalesce("citation_key", F.lit("unknown")).alias("citation_key"), F.coalesce(F.nullif("title", F.lit("")), F.lit("No title")).alias("title"), _text_list(F.col("authors")).alias("authors"),
        F.nullif(number("year"), F.lit("")).cast("int").alias("year"), "doi", F.coalesce("source", F.lit("unknown")).alias("source"), "url", "pdf_path", "added_date", "abstract",
        F.nullif(F.array_join(F.filter(venue, lambda v: v != ""), ", "), F.lit("")).alias("venue"), F.nullif(number("citation_count"), F.lit("")).cast("int").alias("citation_count"), "metadata",
    )


def read_library(spark: SparkSession, path: str) -> DataFrame:
    """SC1, SC3, SC8: entries of a library file, as a map by key or as a list; an unreadable file gives none."""
    raw = spark.read.text(path, wholetext=True).select("value")
    by_key = raw.select(F.explode(F.map_entries(F.from_json(F.get_json_object("value", "$.entries"), f"map<string, struct<{ENTRY.replace(' string', ': string')}>>"))).alias("e"))
    keyed = by_key.select(F.col("e.key").alias("key"), "e.value.*").withColumn("citation_key", F.coalesce("citation_key", "key")).drop("key")
    listed = raw.filter(F.get_json_object("value", "$.entries").startswith("[")).select(F.explode(F.from_json(F.get_json_object("value", "$.entries"), f"array<struct<{ENTRY.replace(' string', ': string')}>>")).alias("e")).select("e.*")
    return coerce_entries(keyed.unionByName(listed))


def read_texts(spark: SparkSession, folder: str, suffix: str = ".txt") -> DataFrame:
    """SC6, SC7, SC37, SC38: (citation_key, text) of whole files, the key from the file's name."""
    rows = spark.read.text(f"{folder}/*{suffix}", wholetext=True).select(F.col("value").alias("text"), F.input_file_name().alias("path"))
    return rows.select(F.regexp_extract(F.url_decode("path"), rf"([^/]+){suffix.replace('.', chr(92) + '.')}$", 1).alias("citation_key"), "text")


def read_pdfs(spark: SparkSession, folder: str, extract: Callable[[bytes], str] | None = None) -> DataFrame:
    """SC35, SC36: (citation_key, text) of PDF files; ``extract`` or, where it is installed, pypdf reads one file."""
    rows = spark.read.format("binaryFile").load(f"{folder}/*.pdf").select(F.regexp_extract(F.url_decode("path"), r"([^/]+)\.pdf$", 1).alias("citation_key"), "content")

    def pages(content: bytes) -> str:
        import pypdf

        return "\n".join(p.extract_text() or "" for p in pypdf.PdfReader(io.BytesIO(content)).pages)

    one = extract or pages

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield pd.DataFrame({"citation_key": part["citation_key"], "text": [one(c) for c in part["content"]]})

    return rows.mapInPandas(run, "citation_key string, text string")


def read_keyed_json(spark: SparkSession, path: str, schema: str, entries: str = "entries") -> DataFrame:
    """SC40-SC43: rows of a tracker file that holds a map of records by key, with the key as ``key``."""
    raw = spark.read.text(path, wholetext=True)
    value = F.col("value") if not entries else F.get_json_object("value", f"$.{entries}")
    return raw.select(F.explode(F.map_entries(F.from_json(value, f"map<string, struct<{schema}>>"))).alias("e")).select(F.col("e.key").alias("key"), "e.value.*")


def fragment(document: str, reference: str) -> str | None:
    """SC44: the text at 'file#a/b' of a JSON document of settings."""
    value = json.loads(document)
    for part in reference.partition("#")[2].strip("/").split("/"):
        if not isinstance(value, dict) or part not in value:
            return None
        value = value[part]
    return value if isinstance(value, str) else json.dumps(value)


@dataclass
class Settings:
    """SC46: settings with defaults, read from the environment."""

    search_limit: int = 25
    search_timeout: int = 30
    pdf_timeout: int = 60
    embedding_timeout: int = 120
    download_threads: int = 4
    embedding_chunk_tokens: int = 1000
    similarity: float = 0.85

    @classmethod
    def from_env(cls, prefix: str = "PAPERLOOM_") -> Settings:
        got = {}
        for f in fields(cls):
            raw = os.environ.get(prefix + f.name.upper())
            if raw is not None:
                try:
                    got[f.name] = type(f.default)(raw)
                except ValueError:
                    continue
        return cls(**got)

    def problems(self) -> list[str]:
        """VD21: settings out of their range."""
        out = [f"{f.name} must be positive" for f in fields(self) if getattr(self, f.name) <= 0]
        return out + (["similarity must be at most 1"] if self.similarity > 1 else [])
