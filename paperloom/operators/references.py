"""References to records that do not exist.

Keys are dictionary-encoded as integers; per key range (32,768 codes) and month one bitmap is
built of the keys referred to, one of the parents that appear and one of those that vanish.
``reference AND-NOT parent`` on these bitmaps leaves the keys that cannot be there; keys whose
parent comes or goes within the month are left to an exact comparison of the times of their rows.

Defined results: null, blank and placeholder values are no references; a row without ``logged_at``
is an orphan only where its target never exists; repeated rows count once per ``entry_id`` and
field; empty tables give an empty result, or make every reference an orphan where the parents
are empty; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.runtime import checkpoint, month_of, salted_join, utc_timestamp

PLACEHOLDERS = ("", "n/a", "na", "none", "null", "nan", "nil", "-", "--", "?", "unknown", "tbd")
RANGE_BYTES = 4096  # bitmap_construct_agg: 32,768 positions
BITS = RANGE_BYTES * 8
#: Reference columns and what they refer to.
FIELDS = {"citation_key": "entry", "pdf_path": "pdf", "summary_path": "summary"}


def _bare(c: Column) -> Column:
    """Without blanks and marks around it."""
    return F.regexp_replace(c, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def normal_key(c: Column) -> Column:
    """A citation key without blanks and marks around it, in lower case; null for no reference."""
    low = F.lower(F.trim(c))
    # keys that are written as they should be, which are most, need no rules
    spelt = F.when(c.rlike("^[a-z0-9]+$"), c).otherwise(F.nullif(F.lower(_bare(c)), F.lit("")))
    return F.when(c.isNull() | low.isin(*PLACEHOLDERS), None).otherwise(spelt)


def _without_steps_up(path: Column) -> Column:
    """A path with each '..' taken together with the folder before it, however many there are; those at its beginning stay."""
    kept = F.aggregate(
        F.split(path, "/"), F.array().cast("array<string>"),
        lambda done, part: F.when((part == "..") & (F.size(done) > 0) & ~F.coalesce(F.element_at(done, -1), F.lit("..")).isin("..", ""), F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(part))),
    )
    return F.array_join(kept, "/")


def normal_path(c: Column, roots: tuple[str, ...] = ("/srv/lit",)) -> Column:
    """One spelling for all ways to write a path: separators, '.', '..', file URLs, known roots, case."""
    low = F.lower(F.regexp_replace(c, r"^[\s\p{Z}\"'<\[(]+|[\s\p{Z}\"'>\])]+$", ""))
    p = F.regexp_replace(F.translate(low, "\\", "/"), r"^file:(//)?", "")
    p = F.regexp_replace(p, r"/{2,}", "/")
    p = F.regexp_replace(p, r"(^|/)(\./)+", "$1")
    p = F.when(p.contains("../"), _without_steps_up(p)).otherwise(p)
    for root in roots:
        p = F.when(F.startswith(p, F.lit(root.lower() + "/")), F.substr(p, F.lit(len(root) + 2))).otherwise(p)
    # paths that are written as they should be, which are most, need no rules
    spelt = F.when(c.rlike(r"^[a-z0-9_-][a-z0-9_.-]*(?:/[a-z0-9_-][a-z0-9_.-]*)*$"), c).otherwise(F.nullif(p, F.lit("")))
    return F.when(c.isNull() | low.isin(*PLACEHOLDERS), None).otherwise(spelt)


def reference_rows(progress: DataFrame) -> DataFrame:
    """(entry_id, ref_field, norm, logged_at, month): one row per reference."""
    each = F.array(*[
        F.struct(F.lit(f).alias("ref_field"), (normal_key if f == "citation_key" else normal_path)(F.col(f)).alias("norm")) for f in FIELDS
    ])
    return (
        progress.select("entry_id", "logged_at", F.explode(each).alias("r"))
        .select("entry_id", "logged_at", "r.ref_field", "r.norm", month_of(F.col("logged_at")).alias("month"))
        .filter(F.col("norm").isNotNull())
    )


def parent_intervals(library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(ref_field, norm, since, until): when a target is there; until is null while it is."""
    entries = library.select(
        F.lit("citation_key").alias("ref_field"), normal_key(F.col("citation_key")).alias("norm"),
        utc_timestamp(F.col("added_date")).alias("since"), utc_timestamp(F.col("metadata")["removed_at"]).alias("until"),
    )
    files = artifacts.filter(F.col("kind").isin("pdf", "summary")).select(
        F.when(F.col("kind") == "pdf", "pdf_path").otherwise("summary_path").alias("ref_field"),
        normal_path(F.col("path")).alias("norm"), F.col("created_at").alias("since"), F.col("deleted_at").alias("until"),
    )
    # a target whose beginning is unknown counts as there from the start
    start = F.timestamp_micros(F.lit(-62_135_596_800_000_000))
    return entries.unionByName(files).filter(F.col("norm").isNotNull()).withColumn("since", F.coalesce("since", start)).distinct()


def pack(bits: bytes) -> bytes:
    """A container: sorted 16-bit positions while these are shorter than the bitmap, else the bitmap."""
    at = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little")).astype(np.uint16)
    return b"a" + at.tobytes() if at.nbytes < RANGE_BYTES else b"b" + bits


def unpack(box: bytes) -> np.ndarray:
    """The packed container as one boolean per position."""
    if box[:1] == b"b":
        return np.unpackbits(np.frombuffer(box[1:], np.uint8), bitorder="little").astype(bool)
    out = np.zeros(BITS, bool)
    out[np.frombuffer(box[1:], np.uint16)] = True
    return out


def _survivors(group: pd.DataFrame) -> pd.DataFrame:
    """AND-NOT over the months of one key range: keys not there at all, and keys to compare by time.

    A group holds at most three packed bitmaps a month, whatever the number of rows."""
    come, gone, ever = np.zeros(BITS, bool), np.zeros(BITS, bool), np.zeros(BITS, bool)
    months = sorted(set(group["month"].dropna()))
    boxes = {(m if m is not None and m == m else None, w): unpack(b) for m, w, b in zip(group["month"], group["what"], group["bits"], strict=True)}
    none = np.zeros(BITS, bool)
    several = boxes.get((None, "several"), none)
    for (_, what), bits in boxes.items():
        if what == "come":
            ever |= bits
    ever |= several
    out: list[tuple] = []

    def emit(month, bits: np.ndarray, state: str) -> None:
        out.extend((month, int(p), state) for p in np.flatnonzero(bits))

    if (None, "ref") in boxes:
        emit(None, boxes[None, "ref"] & ~ever, "absent")
    for m in months:
        new, lost = boxes.get((m, "come"), none), boxes.get((m, "gone"), none)
        ref = boxes.get((m, "ref"))
        if ref is not None:
            some = ((come | new) & ~gone) | several  # there at some time of the month
            whole = come & ~gone & ~lost & ~several  # there all month
            emit(m, ref & ~some, "absent")
            emit(m, ref & some & ~whole, "compare")
        come, gone = come | new, gone | lost
    frame = pd.DataFrame(out, columns=["month", "position", "state"])
    frame.insert(0, "range", group["range"].iloc[0] if len(group) else 0)
    return frame


def orphan_rows(progress: DataFrame, library: DataFrame, artifacts: DataFrame, salts: int = 16) -> DataFrame:
    """(entry_id, ref_field, month, norm) of every reference whose target is not there at ``logged_at``."""
    # read several times below; the spelling rules cost more than writing their results once
    refs, parents = checkpoint(reference_rows(progress)), checkpoint(parent_intervals(library, artifacts))
    used = refs.select("ref_field", "norm", "month").distinct()
    # the dictionary: codes are dense within each partition of the sorted keys; written, since they depend on the partitioning
    codes = checkpoint(
        used.select("ref_field", "norm").distinct().join(parents.select("ref_field", "norm").distinct(), ["ref_field", "norm"], "full")
        .sortWithinPartitions("ref_field", "norm")
        .select("ref_field", "norm", F.monotonically_increasing_id().alias("code"))
    )
    spans = parents.groupBy("ref_field", "norm").agg(F.count(F.lit(1)).alias("n"), F.min("since").alias("since"), F.max("until").alias("until"))
    marks = spans.join(codes, ["ref_field", "norm"]).select(
        "code",
        F.explode(F.when(F.col("n") > 1, F.array(F.struct(F.lit(None).cast("date").alias("month"), F.lit("several").alias("what")))).otherwise(F.array(
            F.struct(month_of(F.col("since")).alias("month"), F.lit("come").alias("what")),
            F.struct(month_of(F.col("until")).alias("month"), F.when(F.col("until").isNotNull(), "gone").alias("what")),
        ))).alias("m"),
    ).select("code", "m.month", "m.what").filter(F.col("what").isNotNull())
    marked = used.join(codes, ["ref_field", "norm"]).select("code", "month", F.lit("ref").alias("what")).unionByName(marks)
    packed = F.pandas_udf(lambda s: s.map(pack), "binary")
    bitmaps = (
        marked.groupBy(F.expr("code div 32768").alias("range"), "month", "what")
        .agg(F.bitmap_construct_agg(F.expr("code % 32768")).alias("bits"))
        .withColumn("bits", packed("bits"))
    )
    left = bitmaps.groupBy("range").applyInPandas(_survivors, "range bigint, month date, position int, state string")
    suspects = left.withColumn("code", F.col("range") * BITS + F.col("position")).join(codes, "code").select("ref_field", "norm", F.col("month").alias("at"), "state")
    at = F.coalesce(F.col("month"), F.to_date(F.lit("0001-01-01")))
    hits = salted_join(
        refs.withColumn("at", at), suspects.withColumn("at", F.coalesce("at", F.to_date(F.lit("0001-01-01")))), ["ref_field", "norm", "at"], F.col("entry_id"), salts
    )
    absent = hits.filter(F.col("state") == "absent")
    compare = hits.filter(F.col("state") == "compare")
    spans_of = F.collect_list(F.struct("since", "until"))
    # the targets to compare with; a key has few intervals, however many rows refer to it
    times = parents.join(suspects.filter(F.col("state") == "compare").select("ref_field", "norm").distinct(), ["ref_field", "norm"]).groupBy("ref_field", "norm").agg(spans_of.alias("spans"))
    late = salted_join(compare, times, ["ref_field", "norm"], F.col("entry_id"), salts).filter(
        ~F.exists("spans", lambda s: (s["since"] <= F.col("logged_at")) & (s["until"].isNull() | (s["until"] > F.col("logged_at"))))
    )
    keep = ["entry_id", "ref_field", "month", "norm"]
    return absent.select(*keep).unionByName(late.select(*keep)).distinct()


def orphan_report(progress: DataFrame, library: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Per field and month of ``logged_at``: references, orphans and different missing keys."""
    orphans = orphan_rows(progress, library, artifacts)
    total = reference_rows(progress).groupBy("ref_field", "month").agg(F.count_distinct("entry_id").alias("n_refs"))
    bad = orphans.groupBy("ref_field", "month").agg(F.count_distinct("entry_id").alias("n_orphans"), F.count_distinct("norm").alias("n_missing_keys"))
    same = (total["ref_field"] == bad["ref_field"]) & total["month"].eqNullSafe(bad["month"])
    return total.join(bad, same, "left").select(
        total["ref_field"], total["month"], "n_refs", F.coalesce("n_orphans", F.lit(0)).alias("n_orphans"), F.coalesce("n_missing_keys", F.lit(0)).alias("n_missing_keys")
    )

