import datetime as dt

import numpy as np
import pytest

from paperloom.operators import references as r

T = lambda *a: dt.datetime(*a, tzinfo=dt.timezone.utc)
PROGRESS = "entry_id bigint, citation_key string, pdf_path string, summary_path string, logged_at timestamp, norm string"
LIBRARY = "citation_key string, added_date string, metadata map<string,string>, month string"
ARTIFACTS = "kind string, path string, created_at timestamp, deleted_at timestamp"


def found(spark, progress, library, artifacts):
    got = r.orphan_rows(spark.createDataFrame(progress, PROGRESS), spark.createDataFrame(library, LIBRARY), spark.createDataFrame(artifacts, ARTIFACTS))
    return sorted((x.entry_id, x.ref_field) for x in got.collect())


def test_times_spellings_and_holes(spark):
    library = [("smith2020deep", "2024-03-10T12:00:00Z", None, "x"), ("doe2021old", "2023-01-01 00:00:00", {"removed_at": "2024-03-10T12:00:00"}, None)]
    artifacts = [("pdf", "data/pdfs/smith2020deep.pdf", T(2024, 1, 1), None), ("summary", "data/summaries/a_summary.md", T(2024, 1, 1), T(2024, 2, 1)), ("text", "data/t.txt", T(2024, 1, 1), None)]
    rows = [
        (1, " @Smith2020DEEP\t", "./data//pdfs/smith2020deep.PDF", None, T(2024, 3, 10, 12), "extra"),
        (2, "smith2020deep", "file:///srv/lit/data/pdfs/smith2020deep.pdf", "data/summaries/a_summary.md", T(2024, 3, 10, 11, 59, 59), None),
        (3, "doe2021old", "papers/../data/pdfs/smith2020deep.pdf", "data\\summaries\\a_summary.md", T(2024, 1, 15), None),
        (4, "doe2021old", "data/pdfs/smith2020deep.pdf.part", "n/a", T(2024, 3, 10, 12), None),
        (5, None, "  ", "None", T(2024, 3, 1), None),
        (6, "nobody", "data/t.txt", "data/summaries/a_summary.md", None, None),
        (7, "smith2020deep", None, None, None, None),
        (8, None, "a/b/c/d/e/../../.././../../data/pdfs/x/../smith2020deep.pdf", "a/../../data/summaries/a_summary.md", T(2024, 1, 15), None),
        (4, "doe2021old", "data/pdfs/smith2020deep.pdf.part", "n/a", T(2024, 3, 10, 12), None),
    ]
    assert found(spark, rows, library, artifacts) == [(2, "citation_key"), (2, "summary_path"), (4, "citation_key"), (4, "pdf_path"), (6, "citation_key"), (6, "pdf_path"), (8, "summary_path")]


def test_empty_tables(spark):
    assert found(spark, [], [], []) == []
    assert found(spark, [(1, "a1", None, None, T(2024, 1, 1), None)], [], []) == [(1, "citation_key")]


def test_several_intervals_of_one_path(spark):
    artifacts = [("pdf", "data/a.pdf", T(2024, 1, 5), T(2024, 1, 10)), ("pdf", "data/a.pdf", T(2024, 1, 20), None)]
    rows = [(n, None, "data/a.pdf", None, T(2024, 1, day), None) for n, day in ((1, 7), (2, 15), (3, 25), (4, 2))]
    assert found(spark, rows, [], artifacts) == [(2, "pdf_path"), (4, "pdf_path")]


def test_report_counts_per_month(spark, data):
    p, lib, a = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("progress", "library", "artifacts"))
    report = r.orphan_report(p, lib, a).collect()
    assert sum(x.n_orphans for x in report) == r.orphan_rows(p, lib, a).select("entry_id", "ref_field").distinct().count()
    assert all(x.n_refs >= x.n_orphans >= x.n_missing_keys for x in report)


@pytest.mark.parametrize("n", [0, 1, 100, 5000, 32768])
def test_containers_round_trip(n):
    bits = np.zeros(32768, bool)
    bits[np.random.default_rng(n).permutation(32768)[:n]] = True
    box = r.pack(np.packbits(bits, bitorder="little").tobytes())
    assert (r.unpack(box) == bits).all() and len(box) <= 4097


def test_brute_force(spark, data):
    import re

    p, lib, a = (spark.read.parquet(f"{data}/{t}.parquet").toPandas() for t in ("progress", "library", "artifacts"))
    keys = {k.lower(): (dt.datetime.fromisoformat(d[:19].replace(" ", "T")), dict(m or []).get("removed_at") if m is not None else None) for k, d, m in zip(lib.citation_key, lib.added_date, lib.metadata, strict=True)}
    want = set()
    for row in p.itertuples():
        key = row.citation_key
        if key is None or key.strip().lower() in r.PLACEHOLDERS:
            continue
        key = re.sub(r"^\W+|\W+$", "", key).lower()
        at = row.logged_at.replace(tzinfo=None)
        span = keys.get(key)
        if not span or at < span[0] or (span[1] and at >= dt.datetime.fromisoformat(span[1][:19])):
            want.add(row.entry_id)
    got = {x.entry_id for x in r.orphan_rows(*(spark.read.parquet(f"{data}/{t}.parquet") for t in ("progress", "library", "artifacts"))).filter("ref_field = 'citation_key'").collect()}
    assert got == want
