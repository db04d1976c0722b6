"""Session helpers: table loading, reliable checkpoints, salted joins."""

from __future__ import annotations

import os
import tempfile
import time
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_FOLDERS: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; only on one machine, as in tests, a temporary one where the session names none."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if sc.applicationId not in _FOLDERS:
        _FOLDERS[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="paperloom-")
    return _FOLDERS[sc.applicationId]


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a copy in the shared folder; copies that nothing refers to any more are removed."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    if sc.getConf().get("spark.cleaner.referenceTracking.cleanCheckpoints") is None:
        sc._jsc.sc().conf().set("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
    return df.checkpoint(eager=True)


def small_enough(df: DataFrame, max_rows: int) -> bool:
    """Whether a table has at most ``max_rows`` rows; reads no more than that many and one."""
    return len(df.limit(max_rows + 1).select(F.lit(1)).collect()) <= max_rows


def month_of(ts: Column) -> Column:
    """First day of the UTC month of a timestamp, whatever the session's time zone."""
    return F.trunc(F.date_from_unix_date(F.floor(F.unix_micros(ts) / F.lit(86_400_000_000)).cast("int")), "MM")


def utc_timestamp(text: Column) -> Column:
    """ISO text of whole seconds ('T' or blank between date and time, 'Z' or nothing behind) as UTC."""
    whole = F.concat(F.translate(F.substring(F.trim(text), 1, 19), "T", " "), F.lit("+00:00"))
    return F.try_to_timestamp(whole, F.lit("yyyy-MM-dd HH:mm:ssXXX"))


def salted_join(left: DataFrame, right: DataFrame, on: list[str], salt_of: Column, salts: int, how: str = "inner") -> DataFrame:
    """Equi-join that spreads a hot key over ``salts`` tasks; the right side is copied ``salts`` times."""
    a = left.withColumn("_salt", F.pmod(F.xxhash64(salt_of), F.lit(salts)).cast("int"))
    b = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b, [*on, "_salt"], how).drop("_salt")


class Stages:
    """SM12: wall times of the steps of a job, as rows for ``ordered.slow_stages``."""

    def __init__(self) -> None:
        self.times: list[tuple[str, float]] = []

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.times.append((name, time.perf_counter() - began))

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.times, "stage string, seconds double")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, where their Python path does not name its folder; once per application."""
    root, app = Path(__file__).resolve().parent.parent, spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    package = Path(tempfile.mkdtemp(prefix="paperloom-")) / "paperloom.zip"
    with zipfile.ZipFile(package, "w") as z:
        for f in sorted((root / "paperloom").rglob("*.py")):
            z.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(package))
    _SHIPPED.add(app)
