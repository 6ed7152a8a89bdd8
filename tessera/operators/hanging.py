"""References to records that do not exist (problem 1).

Parents are range-partitioned on the 64-bit hash of their key and held as
sorted arrays, one array per range.  Each batch of references of a range is
probed by binary search, hits are confirmed on the key text itself, and the
misses come out.  A range that many references name (a hot key) is split: its
references spread over salts and its parent array goes to each salt.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import reference_key

_BITS = 16
_OUT = "table_name string, field string, row_id bigint, ref_id string, reason string, recorded_at timestamp_ntz"


def entity_targets(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """One row per name that an entity reference may use: key, entity_id, registered_at, deleted_at.

    Ids come first; an alias counts only if no id equals it, and is followed
    one step.  Of several records under one name a live one wins over a
    deleted one, then the earliest registered, then the smallest id.
    """
    ids = entities.groupBy(reference_key("id").alias("key")).agg(
        F.min(
            F.struct(
                F.lit(0).alias("rank"),
                F.col("deleted_at").isNotNull().alias("gone"),
                F.coalesce("registered_at", F.to_timestamp_ntz(F.lit("0001-01-01 00:00:00"))).alias("since"),
                F.col("id").alias("entity_id"),
                "registered_at",
                "deleted_at",
            )
        ).alias("v")
    )
    ids = ids.where(F.col("key") != "")
    links = (
        aliases.select(reference_key("alias_id").alias("alias"), reference_key("canonical_id").alias("key"))
        .where("alias != '' and key != ''")
        .distinct()
    )
    via = links.join(ids, "key").select(F.col("alias").alias("key"), F.col("v").withField("rank", F.lit(1)).alias("v"))
    return (
        ids.unionByName(via)
        .groupBy("key")
        .agg(F.min("v").alias("v"))
        .select("key", "v.entity_id", "v.registered_at", "v.deleted_at")
    )


def source_targets(sources: DataFrame) -> DataFrame:
    """One row per source id: key, registered_at, deleted_at; a live record wins."""
    return (
        sources.groupBy(reference_key("source_id").alias("key"))
        .agg(F.min(F.struct(F.col("deleted_at").isNotNull().alias("gone"), "registered_at", "deleted_at")).alias("v"))
        .where("key != ''")
        .select("key", "v.registered_at", "v.deleted_at")
    )


def _probe(refs: pa.Table, parents: pa.Table) -> pa.Table:
    """Misses of one range: binary search by hash, confirmed on the key."""
    n = refs.num_rows
    ref_hash = refs["__hash"].to_numpy()
    found = np.full(n, -1, dtype=np.int64)
    if n and parents.num_rows:
        order = np.argsort(parents["__hash"].to_numpy(), kind="stable")
        parents = parents.take(pa.array(order))
        sorted_hash = parents["__hash"].to_numpy()
        keys, ref_keys = parents["__key"].combine_chunks(), refs["__key"].combine_chunks()
        at = np.searchsorted(sorted_hash, ref_hash)
        open_rows = np.arange(n)
        while len(open_rows):  # more than one turn only where different keys share a hash
            inside = at[open_rows] < len(sorted_hash)
            open_rows = open_rows[inside]
            open_rows = open_rows[sorted_hash[at[open_rows]] == ref_hash[open_rows]]
            if not len(open_rows):
                break
            same = pc.equal(keys.take(pa.array(at[open_rows])), ref_keys.take(pa.array(open_rows)))
            same = same.to_numpy(zero_copy_only=False).astype(bool)
            found[open_rows[same]] = at[open_rows[same]]
            open_rows = open_rows[~same]
            at[open_rows] += 1
    deleted = np.zeros(n, dtype=bool)
    late = np.zeros(n, dtype=bool)
    hit = found >= 0
    if hit.any():
        take = pa.array(found[hit])
        deleted[hit] = pc.is_valid(parents["deleted_at"].take(take)).to_numpy()
        after = pc.greater(parents["registered_at"].take(take), refs["recorded_at"].filter(pa.array(hit)))
        late[hit] = pc.fill_null(after, False).to_numpy()
    reason = np.where(~hit, "missing", np.where(deleted, "deleted", np.where(late, "late", "")))
    keep = pa.array(reason != "")
    out = refs.select(["table_name", "field", "row_id", "ref_id"])
    out = out.append_column("reason", pa.array(reason, pa.string())).append_column("recorded_at", refs["recorded_at"])
    return out.filter(keep)


def hanging_references(
    refs: DataFrame,
    parents: DataFrame,
    rows_per_range: int = 500_000,
    rows_per_salt: int = 100_000,
) -> DataFrame:
    """References without a usable target, each with its reason.

    ``refs``: table_name, field, row_id, ref_id, recorded_at and kind (the
    space of names).  ``parents``: kind, key, registered_at, deleted_at, one
    row per kind and key (see :func:`entity_targets`).  Other columns are
    ignored.  Null and blank references do not count; an empty parent table
    makes every reference missing; an empty reference table gives no rows; a
    null recorded_at or registered_at is never late.  Repeated references
    come out once each.
    """
    refs = (
        refs.select("table_name", "field", "row_id", "ref_id", "recorded_at", "kind")
        .withColumn("__key", reference_key("ref_id"))
        .where("__key is not null and __key != ''")
        .withColumn("__key", F.concat("kind", F.lit(":"), "__key"))
        .withColumn("__hash", F.xxhash64("__key"))
    )
    parents = parents.select(
        F.concat("kind", F.lit(":"), "key").alias("__key"), "registered_at", "deleted_at"
    ).withColumn("__hash", F.xxhash64("__key"))
    # References are counted once, per finest range (2**16 rows at most); from that follow the width of the
    # ranges (the upper bits of the hash), so that parents and, but for hot keys, references fit, and the salts.
    finest = F.shiftright("__hash", 64 - _BITS) + F.lit(1 << (_BITS - 1))
    counted = refs.groupBy(finest.cast("int").alias("r")).agg(F.count(F.lit(1)).alias("n")).collect()
    wanted = max(parents.count() / rows_per_range, sum(r["n"] for r in counted) / rows_per_salt)
    bits = min(_BITS, max(1, math.ceil(math.log2(max(1.0, wanted) + 1))))
    place = F.shiftright("__hash", 64 - bits) + F.lit(1 << (bits - 1))
    refs = refs.withColumn("__range", place.cast("int"))
    parents = parents.withColumn("__range", place.cast("int"))
    per_range: dict[int, int] = {}
    for r in counted:
        at = r["r"] >> (_BITS - bits)
        per_range[at] = per_range.get(at, 0) + r["n"]
    salted = [(at, math.ceil(n / rows_per_salt)) for at, n in per_range.items()]
    salts = F.broadcast(refs.sparkSession.createDataFrame(salted, "__range int, __salts int"))
    refs = refs.join(salts, "__range").withColumn(
        "__salt", F.pmod(F.xxhash64("row_id", "table_name", "field"), F.col("__salts")).cast("int")
    )
    parents = parents.join(salts, "__range").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))
    )
    left = refs.drop("kind", "__salts").groupBy("__range", "__salt")
    right = parents.drop("__salts").groupBy("__range", "__salt")
    return left.cogroup(right).applyInArrow(_probe, _OUT)


def orphan_report(refs: DataFrame, hanging: DataFrame) -> DataFrame:
    """Hanging references per table, field and month, beside all references of the month.

    Months come from recorded_at ('unknown' if null).
    """
    month = F.coalesce(F.date_format("recorded_at", "yyyy-MM"), F.lit("unknown")).alias("month")
    total = (
        refs.where(F.coalesce(reference_key("ref_id"), F.lit("")) != "")
        .groupBy("table_name", "field", month)
        .agg(F.count(F.lit(1)).alias("n_refs"))
    )
    bad = hanging.groupBy("table_name", "field", month).agg(
        *[F.count_if(F.col("reason") == r).alias(f"n_{r}") for r in ("missing", "deleted", "late")]
    )
    return total.join(bad, ["table_name", "field", "month"], "left").fillna(0, ["n_missing", "n_deleted", "n_late"])
