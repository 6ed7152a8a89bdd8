"""Point-in-time filters and temporal checks.  "Today" is always a parameter."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.norm import OPEN_END, col, reference_key, strict_date
from ..session import lookup_join


def as_of(df: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """Rows whose half-open interval [start, end) contains the day.

    Dates are texts; an end that is null, empty or the sentinel is open, a
    start or end that is no real date excludes the row.
    """
    dt.date.fromisoformat(day)
    at = F.lit(day).cast("date")
    open_ = F.col(end).isNull() | F.col(end).isin("", OPEN_END)
    return df.where((strict_date(start) <= at) & (open_ | (at < strict_date(end))))


def local_day(ts: Column | str, zone: str = "Asia/Seoul") -> Column:
    """Calendar day of a UTC timestamp in a zone."""
    return F.to_date(F.from_utc_timestamp(col(ts), zone))


def legal_status_on(start: Column, end: Column, superseded: Column, overruled: Column, day: str) -> Column:
    """Status on a day: overruled, superseded, future (starts later), historical (ended before), else current."""
    at = F.lit(day).cast("date")
    return (
        F.when(overruled, "overruled")
        .when(superseded, "superseded")
        .when(start > at, "future")
        .when(end < at, "historical")
        .otherwise("current")
    )


#: Days after which a review of the cycle is overdue.
CYCLE_DAYS = {"monthly": 31, "quarterly": 92, "annual": 366}


def review_overdue(cycle: Column | str, checked_on: Column | str, day: str) -> Column:
    """Whether more days have passed since the check than the cycle allows; false for an unknown cycle or no date."""
    days = F.element_at(F.create_map(*[F.lit(x) for kv in CYCLE_DAYS.items() for x in kv]), col(cycle))
    passed = F.datediff(F.lit(day).cast("date"), strict_date(checked_on))
    return F.coalesce(passed > days, F.lit(False))


def first_valid_date(candidates: list[tuple[str, Column]]) -> Column:
    """struct(label, day) of the first candidate that is a real date; null if none is."""
    options = [
        F.when(strict_date(c).isNotNull(), F.struct(F.lit(label).alias("label"), c.alias("day"))) for label, c in candidates
    ]
    return F.coalesce(*options)


def successor_overlaps(df: DataFrame, entity: str, start: str, end: str, row: str) -> DataFrame:
    """Rows whose next interval of the entity (by start, then row) begins before they end, with that start.

    Dates are texts; rows without real dates or entity are left out.  The next
    start is looked for among the entity's distinct start days, one row per
    day at most, so a hot entity makes no large sort.
    """
    days = df.select(entity, row, strict_date(start).alias("first"), strict_date(end).alias("stop")).where(
        F.col(entity).isNotNull() & F.col("first").isNotNull() & F.col("stop").isNotNull()
    )
    starts = days.groupBy(entity, "first").agg(F.max(row).alias("__last"))
    starts = starts.withColumn("__next", F.lead("first").over(Window.partitionBy(entity).orderBy("first")))
    following = F.when(F.col(row) < F.col("__last"), F.col("first")).otherwise(F.col("__next"))
    joined = lookup_join(days, starts, [entity, "first"], [row]).withColumn("next_first", following)
    return joined.where("next_first < stop").select(entity, row, "first", "stop", "next_first")


def timeline_issues(df: DataFrame, path: str, pairs: list[tuple[str, str, str]]) -> DataFrame:
    """Issues of date pairs in the wrong order: (code, earlier column, later column); equal days are allowed."""
    from .graph import issue

    parts = [
        df.where(strict_date(a) > strict_date(b)).select(
            *issue("high", code, path, b, F.concat(F.col(a), F.lit(" > "), F.col(b)))
        )
        for code, a, b in pairs
    ]
    return reduce(DataFrame.unionByName, parts)


#: States of a record that has been replaced or struck down.
ENDED = ("superseded", "overruled")


def supersession_issues(records: DataFrame, targets: DataFrame) -> DataFrame:
    """Issues of records that others replace: themselves or none as successor, dates in the wrong order, no end.

    ``records``: id, legal_status, effective_from, effective_to,
    superseded_by, superseded_date as texts ('' or null for none).
    ``targets``: key, entity_id of every known name.  A date that is none
    takes part in no order.
    """
    from .record_rules import row_rules

    keyed = records.withColumn("__key", reference_key("superseded_by"))
    named = lookup_join(keyed.where("__key != ''"), targets.select(F.col("key").alias("__key"), "entity_id"), ["__key"], ["id"], "left")
    own = (F.col("__key") == reference_key("id")) | F.coalesce(F.col("entity_id") == F.col("id"), F.lit(False))
    code = F.when(own, "SUPERSESSION_SELF_REFERENCE").when(F.col("entity_id").isNull(), "SUPERSESSION_TARGET_BROKEN")
    ends = named.where(code.isNotNull()).select(
        F.lit("critical").alias("severity"), code.alias("code"), F.col("id").alias("path"), F.lit("superseded_by").alias("field"), F.col("superseded_by").alias("message")
    )
    dates = row_rules(records, "entities", "id", [
        ("high", "SUPERSESSION_DATE_ORDER", "superseded_date", strict_date("superseded_date") < strict_date("effective_from"), F.col("superseded_date")),
        ("medium", "SUPERSESSION_OPEN_ENDED", "effective_to", F.col("legal_status").isin(*ENDED) & (F.col("effective_to") == OPEN_END), F.col("legal_status")),
    ])
    return ends.unionByName(dates.withColumn("path", F.regexp_replace("path", "^entities/", "")))


def verification_timeline(records: DataFrame, evidence: DataFrame, day: str, sources: tuple[str, ...] = ("case", "law", "interpretation")) -> DataFrame:
    """Issues of when records and their evidence were verified, checked and taken in, as of a day.

    ``records``: id, entity_type, status, ingestion_status, last_verified,
    last_checked.  ``evidence``: evidence_row, entity_id, verified_on.  Texts
    that are no date take part in no comparison; records of the types
    ``sources`` need evidence once their ingestion is verified.
    """
    from .graph import issue
    from .record_rules import row_rules

    at = F.lit(day).cast("date")
    known = records.select(F.col("id").alias("entity_id"), (F.col("status") == "verified").alias("__verified"), strict_date("last_verified").alias("__last"))
    dated = evidence.select("evidence_row", "entity_id", "verified_on", strict_date("verified_on").alias("__on")).where("__on is not null")
    joined = lookup_join(dated, known, ["entity_id"], ["evidence_row"], "left")
    rows = row_rules(joined, "evidence", "evidence_row", [
        ("high", "EVIDENCE_VERIFIED_IN_FUTURE", "verified_on", F.col("__on") > at, F.col("verified_on")),
        ("high", "EVIDENCE_AFTER_LAST_VERIFIED", "verified_on", F.col("__verified") & (F.col("__on") > F.col("__last")), F.col("verified_on")),
    ])
    later = (F.col("status") == "verified") & (strict_date("last_verified") > strict_date("last_checked"))
    bare = records.where((F.col("status") != "verified") & (F.col("ingestion_status") == "verified") & F.col("entity_type").isin(*sources))
    some = evidence.select(F.col("entity_id").alias("id")).where("id is not null").distinct()
    parts = [
        records.where(later).select(*issue("high", "VERIFICATION_AFTER_CHECK", "id", "last_checked", F.col("last_checked"))),
        lookup_join(bare, some, ["id"], ["id"], "left_anti").select(
            *issue("medium", "INGESTION_VERIFIED_EVIDENCE_MISSING", "id", "evidence", F.col("entity_type"))
        ),
    ]
    return reduce(DataFrame.unionByName, parts, rows)
