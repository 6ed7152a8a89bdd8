"""Name resolution: names of records, references to them, aliases that chain."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.norm import basename, normalized_ref, text_list
from ..session import cut_lineage, lookup_join


def name_table(records: DataFrame, entity: str, singles: list[str], lists: list[str]) -> DataFrame:
    """key, entity_id: every name of every record, whole and as its last path part.

    Null and blank names give nothing; a record's equal names give one row.
    """
    parts = [F.array(F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in singles] + [text_list(c) for c in lists]
    each = records.select(F.col(entity).alias("entity_id"), F.explode(F.concat(*parts)).alias("name"))
    keys = F.array(normalized_ref("name"), normalized_ref(basename(normalized_ref("name"))))
    return each.select("entity_id", F.explode(keys).alias("key")).where("key != '' and entity_id is not null").distinct()


def match_counts(names: DataFrame) -> DataFrame:
    """key, n_matches, entity_id (the only one, else null): what a key means."""
    return names.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_matches"), F.min("entity_id").alias("__one")
    ).select("key", "n_matches", F.when(F.col("n_matches") == 1, F.col("__one")).alias("entity_id"))


def resolve(refs: DataFrame, names: DataFrame, ref: str, spread: list[str]) -> DataFrame:
    """``refs`` with n_matches and resolved_id; the last path part counts only if the whole key has no match.

    resolved_id is the single match, else null (none or ambiguous).  Null and
    blank references have no match.
    """
    counts = match_counts(names)
    full = refs.withColumn("__key", normalized_ref(F.coalesce(F.col(ref), F.lit("")))).withColumn(
        "__base", normalized_ref(basename("__key"))
    )
    whole = counts.select(F.col("key").alias("__key"), F.col("n_matches").alias("__n1"), F.col("entity_id").alias("__e1"))
    last = counts.select(F.col("key").alias("__base"), F.col("n_matches").alias("__n2"), F.col("entity_id").alias("__e2"))
    found = lookup_join(lookup_join(full, whole, ["__key"], spread, "left"), last, ["__base"], spread, "left")
    return (
        found.withColumn("n_matches", F.coalesce("__n1", "__n2", F.lit(0).cast("bigint")))
        .withColumn("resolved_id", F.when(F.col("__n1").isNotNull(), F.col("__e1")).otherwise(F.col("__e2")))
        .drop("__key", "__base", "__n1", "__n2", "__e1", "__e2")
    )


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """First row per key in a total order, by a partial aggregate instead of a sort of the group."""
    rest = [c for c in df.columns if c not in keys]
    place = F.struct(*[F.col(o) if isinstance(o, str) else o for o in order])
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), place).alias("__v")).select(*keys, "__v.*")


def id_targets(sources: list[DataFrame]) -> DataFrame:
    """target, entity_id: the union of tables of that form, an earlier table winning over a later one."""
    ranked = reduce(
        DataFrame.unionByName,
        [s.select("target", "entity_id", F.lit(k).alias("rank")) for k, s in enumerate(sources)],
    )
    return first_by(ranked.where("target is not null and target != ''"), ["target"], ["rank", "entity_id"]).drop("rank")


def alias_closure(links: DataFrame, spark: SparkSession, max_depth: int | None = None) -> DataFrame:
    """alias, target, depth, is_cycle: where each alias ends.

    ``links``: alias, target, at most one per alias (the smallest target
    counts).  Paths are shortened by doubling, so a chain of n links takes
    log2(n) joins, until nothing moves.  What still moves after as many links
    as there are aliases runs into a cycle, and has a target and depth on its
    way; a ``max_depth`` calls a cycle what moves after so many.  Null and
    blank aliases are left out.
    """
    links = links.where("alias is not null and trim(alias) != '' and target is not null")
    now = links.groupBy("alias").agg(F.min("target").alias("target")).withColumn("depth", F.lit(1).cast("bigint"))
    now, step = cut_lineage(now.withColumn("is_cycle", F.lit(False))), 1
    n_aliases = now.count()
    longest = n_aliases if max_depth is None else min(n_aliases, max_depth)
    while True:
        ahead = now.select(F.col("alias").alias("target"), F.col("target").alias("__next"), F.col("depth").alias("__d"))
        joined = lookup_join(now, ahead, ["target"], ["alias"], "left").select(
            "alias", F.coalesce("__next", "target").alias("target"),
            (F.col("depth") + F.coalesce("__d", F.lit(0).cast("bigint"))).alias("depth"),
            F.col("__next").isNotNull().alias("is_cycle"),  # it moved, though it had gone ``step`` links
        )
        now = cut_lineage(joined)  # a step uses the one before it several times
        if step >= longest or now.where("is_cycle").isEmpty():
            return now
        step *= 2


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n_rows of every key that more than one row has; null keys count as one key."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows")).where("n_rows > 1")


def later_duplicates(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows whose key an earlier row (smaller ``order``) has; of equal orders one row is the first."""
    keyed = df.withColumn("__key", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}))  # nulls are equal
    first = keyed.groupBy("__key").agg(F.min(order).alias("__first"))
    return lookup_join(keyed, first, ["__key"], [order]).where(F.col(order) > F.col("__first")).select(*df.columns)


def numbered(df: DataFrame, group: str, order: list, name: str = "number") -> DataFrame:
    """Running number from 1 within a group.

    A frequent group is no single task's sort: rows are range-partitioned over
    the whole order, counted per group and partition, and numbered within.
    """
    order = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = df.repartitionByRange(F.col(group), *order).withColumn("__part", F.spark_partition_id())
    placed = cut_lineage(placed)  # the partitions must be the same for both uses
    sizes = placed.groupBy(group, "__part").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(group).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("__before", F.coalesce(F.sum("__n").over(ahead), F.lit(0))).drop("__n")
    inner = Window.partitionBy(group, "__part").orderBy(*order)
    inner_number = placed.withColumn("__inner", F.row_number().over(inner))
    joined = inner_number.alias("l").join(
        before.alias("r"),
        F.col(f"l.{group}").eqNullSafe(F.col(f"r.{group}")) & (F.col("l.__part") == F.col("r.__part")),
    )
    return joined.select("l.*", (F.col("l.__inner") + F.col("r.__before")).alias(name)).drop("__inner", "__part")


def number_links(records: DataFrame, number: str, texts: DataFrame, text: str, row: str, pattern: str) -> DataFrame:
    """row, entity_id of every record whose number stands in a text.

    Numbers are cut out of the texts by their form and joined, instead of
    looking for every number in every text.  ``records``: entity_id and the
    number column; blank numbers link nothing, a text links a record once.
    """
    found = texts.select(row, F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))).alias("__n"))
    known = records.where(F.trim(F.coalesce(F.col(number), F.lit(""))) != "").select("entity_id", F.trim(number).alias("__n")).distinct()
    return lookup_join(found, known, ["__n"], [row]).select(row, "entity_id").distinct()


def needle_links(related: DataFrame, needles: list[str], text: str) -> DataFrame:
    """Rows whose text has one of the needle columns in it, blanks removed and case folded.

    ``related``: a record's text and a related record's numbers and title per
    row, as the related records are few.  Blank needles and null texts link nothing.
    """
    one = lambda n: (markup.compacted(n) != "") & F.contains(markup.compacted(text), markup.compacted(n))
    return related.where(reduce(lambda a, b: a | b, [F.coalesce(one(n), F.lit(False)) for n in needles]))
