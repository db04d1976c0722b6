import datetime as dt

import pytest
from pyspark.sql import functions as F

from paperloom.__main__ import main
from paperloom.functions import providers
from paperloom.operators import ordered
from paperloom.operators import vectors as vec
from paperloom.runtime import Stages
from paperloom.sources import connector, files, payloads
from paperloom.streaming import streams


def test_command(spark, data, tmp_path, capsys):
    assert main(["list"]) == 0 and "ag2_by_year" in capsys.readouterr().out
    assert main(["run", "nothing", "--data", data, "--out", str(tmp_path / "x")], spark) == 1 and main(["wrong"]) == 2
    assert main(["run", "ag2_by_year", "--data", data, "--out", str(tmp_path / "o"), "--format", "json"], spark) == 0
    assert spark.read.json(str(tmp_path / "o")).count() > 0


def test_payload_folder(spark, tmp_path):
    (tmp_path / "semanticscholar-active.json").write_text('{"data": [{"title": "T"}]}')
    (tmp_path / "notes.txt").write_text("x")
    spark.dataSource.register(connector.PayloadSource)
    got = payloads.parse(spark.read.format("payloads").load(str(tmp_path))).collect()
    assert [(r.keyword, r.title) for r in got] == [("active", "T")]
    got = connector.payload_files(spark, str(tmp_path)).collect()
    assert [(r.keyword, r.source, r.payload) for r in got] == [("active", "semanticscholar", '{"data": [{"title": "T"}]}')]


def test_similarity_checks(spark):
    ok = spark.createDataFrame([(1, 1, 1.0), (2, 2, 0.0), (1, 2, 0.5), (2, 1, 0.5)], "a int, b int, cosine double")
    r = vec.similarity_checks(ok).collect()[0]
    assert (r.n, r.out_of_range, r.bad_diagonal, r.asymmetric, r.mean_off_diagonal) == (4, 0, 0, 0, 0.5)
    bad = spark.createDataFrame([(1, 1, 0.9), (1, 2, 1.5), (2, 1, 0.5)], "a int, b int, cosine double")
    r = vec.similarity_checks(bad).collect()[0]
    assert (r.out_of_range, r.bad_diagonal, r.asymmetric) == (1, 1, 2)


def test_sessions_and_deliveries(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1, 0, 0) + dt.timedelta(minutes=m)
    rows = [(1, "a", at(0)), (2, "a", at(10)), (3, "a", at(90)), (1, "a", at(1)), (4, "b", at(5)), (9, "z", at(600))]
    spark.createDataFrame(rows, "entry_id bigint, k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("entry_id bigint, k string, ts timestamp").parquet(str(tmp_path / "in"))
    streams.run_to_parquet(streams.sessions(stream(), "ts", "k"), str(tmp_path / "o1"), str(tmp_path / "c1"))
    assert sorted((r.k, r.n) for r in spark.read.parquet(str(tmp_path / "o1")).collect()) == [("a", 1), ("a", 3), ("b", 1)]
    streams.run_to_parquet(streams.deliveries_once(stream(), "entry_id", "ts"), str(tmp_path / "o2"), str(tmp_path / "c2"))
    assert sorted(r.entry_id for r in spark.read.parquet(str(tmp_path / "o2")).collect()) == [1, 2, 3, 4, 9]


def test_ordered_rules(spark):
    log = spark.createDataFrame([(i, "m", dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms), "u") for i, ms in enumerate((0, 900, 1500, 2400, 2600))], "event_id bigint, msg string, ts timestamp, u string")
    assert sorted(r.event_id for r in ordered.log_dedup_batch(log, "msg", "ts", ["u"], 1.0).collect()) == [0, 2, 4]
    h = spark.createDataFrame([("s", 1, False), ("s", 2, True), ("s", 3, True), ("t", 1, True)], "source string, n int, failed boolean")
    assert {r.source: (r.consecutive_failures, r.healthy) for r in ordered.source_health(h, "source", [F.col("n").desc()], F.col("failed"), 2).collect()} == {"s": (2, False), "t": (1, True)}
    e = spark.range(1).select(ordered.eta(F.lit(2), F.lit(10), F.lit(4.0)).alias("l"), ordered.eta(F.lit(0), F.lit(10), F.lit(4.0)).alias("z"), ordered.eta_ema(F.array(F.lit(1.0), F.lit(2.0)), F.lit(10)).alias("e")).collect()[0]
    assert (e.l, e.z, round(e.e, 6)) == (16.0, None, 13.0)
    one = spark.createDataFrame([(i, float(i), "g") for i in range(12)] + [(100, 5.0, "h")], "i int, v double, g string")
    got = {r.i: r.trend for r in ordered.moving_average(one, "v", ["i"], ["g"]).collect()}
    assert got == {9: 4.5, 10: 5.5, 11: 6.5, 100: 5.0}


def test_retries_settings_and_stages(spark):
    calls, waits = [], []

    def shaky(texts):
        calls.append(texts)
        if len(calls) < 3:
            raise ConnectionError("later")
        return ["ok"] * len(texts)

    assert providers.retrying(shaky, 3, 1.0, waits.append)(["a"]) == ["ok"] and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        providers.retrying(lambda t: int("x"), 2, 0.0, waits.append)(["a"])
    assert providers.model_options("llama3:8b")["class"] == "medium" and providers.model_options("tiny")["class"] == "unknown"
    assert files.Settings().problems() == [] and files.Settings(search_limit=0, similarity=2.0).problems() == ["search_limit must be positive", "similarity must be at most 1"]
    stages = Stages()
    for name in "abc":
        with stages.stage(name):
            pass
    stages.times.append(("slow", 100.0))
    assert [r.stage for r in ordered.slow_stages(stages.table(spark), "stage", "seconds").collect()] == ["slow"]
