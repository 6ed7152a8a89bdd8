"""Attributes as known at event time (problem 6).

Each attribute has a change history of its own: entity, attribute, value, the
days on which the value holds *and* is known, and an order that says which of
several wins.  An event asks one day.  A history interval is cut into dyadic
day ranges (at most two per level), an event day lies in one range of each
level, so the last-known match is an equi-join on (entity, attribute, range).
Both sides are reduced to one row per key before the join, so neither a hot
entity nor a hot day makes a large group; no pair of event and version is
formed.  The matches of the attributes are pivoted back at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import day_number, end_day
from ..session import cut_lineage, lookup_join


def attribute_history(
    versions: DataFrame,
    attributes: list[str],
    entity: str = "entity_id",
    start: str = "valid_from",
    end: str = "valid_until",
    known: str = "indexed_at",
    row: str = "chunk_row",
    end_inclusive: bool = False,
) -> DataFrame:
    """Change histories, one row per version and attribute.

    Columns: entity_id, attribute, from_day, stop_day, rank (what wins: latest
    start, then latest known, then largest row), value.  A version is known
    from the day of ``known`` on, so a query day sees it only from the later
    of its start and that day.  Versions without a valid interval or without
    ``known`` never match and are left out.  A null value is a value.
    """
    base = versions.select(
        F.col(entity).alias("entity_id"),
        day_number(start).alias("first"),
        end_day(end, end_inclusive).alias("stop_day"),
        F.unix_date(F.to_date(known)).alias("known_day"),
        F.col(known).alias("known_at"),
        F.col(row).alias("version_row"),
        *[F.col(a).cast("string").alias(f"__a_{a}") for a in attributes],
    ).where("first is not null and stop_day > first and known_day is not null and entity_id is not null")
    base = base.withColumn("from_day", F.greatest("first", "known_day")).where("stop_day > from_day")
    pairs = F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(f"__a_{a}").alias("value")) for a in attributes])
    return base.select(
        "entity_id",
        F.explode(pairs).alias("p"),
        "from_day",
        "stop_day",
        F.struct("first", "known_at", "version_row").alias("rank"),
    ).select("entity_id", "p.attribute", "from_day", "stop_day", "rank", "p.value")


def last_known(events: DataFrame, history: DataFrame) -> DataFrame:
    """Winning history row of each distinct event key (entity_id, day) and attribute.

    ``events``: entity_id, day.  Output: entity_id, day, attribute, rank, value.
    Events before any known version have no row.
    """
    events = events.select("entity_id", "day").where("entity_id is not null and day is not null").distinct()
    span = events.agg(F.min("day").alias("a"), F.max("day").alias("b")).first()
    low, high = (span["a"], span["b"]) if span["a"] is not None else (0, 0)
    levels = max(1, (high - low + 1).bit_length())
    clipped = (
        history.withColumn("__a", F.greatest(F.col("from_day"), F.lit(low)) - low)
        .withColumn("__b", F.least(F.col("stop_day"), F.lit(high + 1)) - low)
        .where("__a < __b")
    )

    def ranges(level: int):
        """At most two ranges of this level in the minimal cover of [a, b)."""
        lo = F.shiftright(F.col("__a") + ((1 << level) - 1), level)
        hi = F.shiftright(F.col("__b"), level)
        inside = lo < hi
        at = lambda x: F.struct(F.lit(level).alias("level"), x.alias("place"))
        return [F.when(inside & (lo % 2 == 1), at(lo)), F.when(inside & (hi % 2 == 1), at(hi - 1))]

    cover = F.array_compact(F.array(*[r for level in range(levels + 1) for r in ranges(level)]))
    best = F.max(F.struct("rank", "value")).alias("best")
    nodes = (
        clipped.select("entity_id", "attribute", "rank", "value", F.explode(cover).alias("node"))
        .groupBy("entity_id", "attribute", "node")
        .agg(best)
    )
    path = F.array(
        *[
            F.struct(F.lit(level).alias("level"), F.shiftright(F.col("day") - low, level).alias("place"))
            for level in range(levels + 1)
        ]
    )
    asks = events.select("entity_id", "day", F.explode(path).alias("node"))
    return (
        asks.join(nodes, ["entity_id", "node"])
        .groupBy("entity_id", "day", "attribute")
        .agg(F.max("best").alias("best"))
        .select("entity_id", "day", "attribute", "best.rank", "best.value")
    )


def as_known(
    events: DataFrame, history: DataFrame, attributes: list[str], event_row: str, keep: list[str] | None = None
) -> DataFrame:
    """Events with each attribute's last-known value: <attribute> and <attribute>_row.

    ``events``: ``event_row``, entity_id, day and the columns named in
    ``keep``; others are ignored.  Events without any match are left out.
    """
    keep = keep or []
    events = cut_lineage(events.select(event_row, "entity_id", "day", *keep))  # used several times below
    matched = last_known(events, history)
    wide = matched.groupBy("entity_id", "day").agg(
        *[
            x
            for a in attributes
            for x in (
                F.max(F.when(F.col("attribute") == a, F.col("value"))).alias(a),
                F.max(F.when(F.col("attribute") == a, F.col("rank.version_row"))).alias(f"{a}_row"),
            )
        ]
    )
    return lookup_join(events, wide, ["entity_id", "day"], [event_row])


def required_entities(qa: DataFrame, targets: DataFrame, id_arrays: list[str], as_of: str = "as_of") -> DataFrame:
    """qa_row, entity_id, day: distinct entities that a case requires, ids resolved.

    Cases whose day is no real date and ids that resolve to nothing are left
    out; null arrays and blank elements count as absent.
    """
    from ..functions.norm import reference_key

    each = [
        qa.select("qa_row", day_number(as_of).alias("day"), F.explode(c).alias("ref")).where("day is not null")
        for c in id_arrays
    ]
    refs = (
        reduce(DataFrame.unionByName, each)
        .select("qa_row", "day", reference_key("ref").alias("key"))
        .where("key is not null and key != ''")
        .distinct()
    )
    found = lookup_join(refs, targets.select("key", "entity_id"), ["key"], ["qa_row"])
    return found.select("qa_row", "entity_id", "day").distinct()
