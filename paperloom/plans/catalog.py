"""All queries of the core, with the SQL to check them by."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.operators import references
from paperloom.plans import check_queries, library_queries, more_queries, other_queries, payload_queries, text_queries
from paperloom.runtime import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """References whose target is not there at ``logged_at``; one row per entry and field."""
    return references.orphan_rows(table(spark, d, "progress"), table(spark, d, "library"), table(spark, d, "artifacts")).select("entry_id", "ref_field").distinct()


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """References, orphans and missing keys per field and month."""
    return references.orphan_report(table(spark, d, "progress"), table(spark, d, "library"), table(spark, d, "artifacts"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Keyword trends over the documents."""
    return text_queries.keyword_trends(spark, d)


QUERIES |= {"p3_found": p3_found, "p3_report": p3_report}

_HOLES = "('','n/a','na','none','null','nan','nil','-','--','?','unknown','tbd')"


def _sql_path(c: str) -> str:
    p = f"regexp_replace(lower(regexp_replace({c}, '^[\\s\\pZ\"''<\\[(]+|[\\s\\pZ\"''>\\])]+$', '', 'g')), '\\\\', '/', 'g')"
    p = f"regexp_replace(regexp_replace({p}, '^file:(//)?', ''), '/{{2,}}', '/', 'g')"
    p = f"regexp_replace(regexp_replace({p}, '^(\\./)+', ''), '^[^/.]+/\\.\\./', '')"
    return f"case when lower(trim({c})) in {_HOLES} then null else nullif(regexp_replace({p}, '^/srv/lit/', ''), '') end"


def _sql_key(c: str) -> str:
    return f"case when lower(trim({c})) in {_HOLES} then null else nullif(lower(regexp_replace({c}, '^[^\\pL\\pN]+|[^\\pL\\pN]+$', '', 'g')), '') end"


_P3_WITH = f"""
with refs as (
  select distinct entry_id, logged_at, 'citation_key' as ref_field, {_sql_key('citation_key')} as norm from progress
  union select entry_id, logged_at, 'pdf_path', {_sql_path('pdf_path')} from progress
  union select entry_id, logged_at, 'summary_path', {_sql_path('summary_path')} from progress),
parents as (
  select 'citation_key' as ref_field, {_sql_key('citation_key')} as norm, cast(replace(substr(added_date, 1, 19), 'T', ' ') as timestamp) as since,
    cast(replace(substr(metadata['removed_at'], 1, 19), 'T', ' ') as timestamp) as until from library
  union select case kind when 'pdf' then 'pdf_path' else 'summary_path' end, {_sql_path('path')}, cast(created_at at time zone 'UTC' as timestamp), cast(deleted_at at time zone 'UTC' as timestamp)
  from artifacts where kind in ('pdf', 'summary')),
r as (select entry_id, ref_field, norm, cast(logged_at at time zone 'UTC' as timestamp) as t from refs where norm is not null),
there as (select distinct r.entry_id, r.ref_field from r join parents p on r.ref_field = p.ref_field and r.norm = p.norm and p.since <= r.t and (p.until is null or p.until > r.t)),
orphans as (select r.* from r anti join there using (entry_id, ref_field))
"""
ORACLES |= {
    "p3_found": _P3_WITH + "select distinct entry_id, ref_field from orphans",
    "p3_report": _P3_WITH + """
select a.ref_field, a.month, a.n_refs, coalesce(b.n_orphans, 0) as n_orphans, coalesce(b.n_missing_keys, 0) as n_missing_keys
from (select ref_field, cast(date_trunc('month', t) as date) as month, count(distinct entry_id) as n_refs from r group by 1, 2) a
left join (select ref_field, cast(date_trunc('month', t) as date) as month, count(distinct entry_id) as n_orphans, count(distinct norm) as n_missing_keys from orphans group by 1, 2) b
using (ref_field, month)""",
}

for part in (library_queries, text_queries, other_queries, payload_queries, check_queries, more_queries):
    QUERIES |= part.QUERIES
    ORACLES |= part.ORACLES
