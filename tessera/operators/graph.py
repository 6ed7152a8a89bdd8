"""Nodes and de-duplicated, typed edges with the evidence for each."""

from __future__ import annotations

from functools import reduce
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.norm import edge_id
from ..session import cut_lineage, lookup_join

NODE = ("id", "node_type", "title", "owner_id")


def union_nodes(parts: list[DataFrame]) -> DataFrame:
    """One table of nodes, columns missing in a part null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ordered_items(df: DataFrame, keys: list[str], item: str, order: str) -> DataFrame:
    """keys, items: distinct non-blank items of each key, each at its first place.

    Repeats are reduced before any list is formed, so a list has one entry per
    distinct item however many rows repeat it.
    """
    one = df.where(f"{item} is not null and trim({item}) != ''").groupBy(*keys, item).agg(F.min(order).alias("__o"))
    pairs = F.array_sort(F.collect_list(F.struct("__o", item)))
    return one.groupBy(*keys).agg(F.transform(pairs, lambda p: p[item]).alias("items"))


def merge_edges(rows: DataFrame, lists: list[str], order: str = "ord") -> DataFrame:
    """source, relation, target, one row each, with every list column's distinct values in order.

    Rows with an empty endpoint make no edge (see :func:`edge_issues`).  The
    rows of an edge are reduced to their distinct values and the first place
    of each before any list is formed; a list is as long as an edge has
    distinct values.
    """
    keys = ["source", "relation", "target"]
    rows = rows.where("coalesce(source, '') != '' and coalesce(target, '') != ''")
    # A null value stands for the row itself, which the first list counts.
    each = F.posexplode(F.array(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")) for c in lists]))
    long = rows.select(*keys, order, *[F.col(c).cast("string").alias(f"__v{k}") for k, c in enumerate(lists)], each.alias("__list", "__some"))
    item = F.coalesce(*[F.when((F.col("__list") == k) & F.col("__some").isNotNull(), F.col(f"__v{k}")) for k in range(len(lists))])
    one = long.select(*keys, "__list", item.alias("item"), order).groupBy(*keys, "__list", "item").agg(
        F.min(order).alias("__o"), F.count(F.lit(1)).alias("__n")
    )
    listed = lambda k: F.array_sort(F.collect_list(F.when((F.col("__list") == k) & F.col("item").isNotNull(), F.struct("__o", "item"))))
    wide = one.groupBy(*keys).agg(
        F.sum(F.when(F.col("__list") == 0, F.col("__n"))).alias("n_rows"),
        *[F.transform(listed(k), lambda p: p["item"]).alias(c) for k, c in enumerate(lists)],
    )
    return wide.select(edge_id("source", "relation", "target").alias("id"), *keys, "n_rows", *lists)


def evidence_links(text_links: str) -> Column:
    """Array of (evidence_ref, locator, claim_ref) of a list of such objects as JSON texts."""
    return F.transform(text_links, lambda x: F.from_json(x, "evidence_ref string, locator string, claim_ref string"))


def evidence_link(evidence_ref: Column | str, locator: Column | str, claim_ref: Column | str) -> Column:
    """One link as a JSON text, so that equal links count once in a list; null without evidence."""
    parts = [F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")) for c in (evidence_ref, locator, claim_ref)]
    link = F.to_json(F.struct(*[p.alias(n) for p, n in zip(parts, ("evidence_ref", "locator", "claim_ref"), strict=True)]))
    return F.when(parts[0] != "", link)


def authority_edges(records: DataFrame) -> DataFrame:
    """Edges of authorities: has_primary_authority for the primary role, else has_authority.

    ``records``: id, authorities (array of target_id, role, note), ord.
    """
    each = records.select("id", "ord", F.explode("authorities").alias("a"))
    relation = F.when(F.col("a.role") == "primary", "has_primary_authority").otherwise("has_authority")
    return each.select(F.col("id").alias("source"), relation.alias("relation"), F.trim("a.target_id").alias("target"), F.lit("authorities").alias("origin"), F.col("a.note").alias("note"), "ord")


def conflict_nodes(records: DataFrame) -> DataFrame:
    """Nodes of conflicts.  ``records``: id, conflicts (array of conflict_id, type, status, target_ids, note), ord."""
    each = records.select("id", F.explode("conflicts").alias("c"))
    return each.select(conflict_node("id", "c.conflict_id").alias("id"), F.lit("conflict").alias("node_type"), F.col("c.conflict_id").alias("title"), F.col("id").alias("owner_id"))


def conflict_edges(records: DataFrame) -> DataFrame:
    """Edges from a record to its conflicts and from these to what they are about."""
    each = records.select("id", "ord", F.explode("conflicts").alias("c")).withColumn("node", conflict_node("id", "c.conflict_id"))
    common = [F.lit("conflicts").alias("origin")]
    has = each.select(F.col("id").alias("source"), F.lit("has_conflict").alias("relation"), F.col("node").alias("target"), *common, F.lit(None).cast("string").alias("note"), "ord")
    about = each.select("node", "c.note", "ord", F.explode("c.target_ids").alias("target"))
    return has.unionByName(
        about.select(F.col("node").alias("source"), F.lit("conflicts_with").alias("relation"), F.trim("target").alias("target"), *common, "note", "ord")
    )


def conflict_node(entity: Column | str, conflict: Column | str) -> Column:
    return F.concat(F.lit("conflict:"), F.col(entity) if isinstance(entity, str) else entity, F.lit("#"), F.col(conflict) if isinstance(conflict, str) else conflict)


def ordered_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.orderBy("node_type", "id")


def ordered_edges(edges: DataFrame) -> DataFrame:
    return edges.orderBy("source", "relation", "target")


def issue(severity: str, code: str, path: Column | str, field: str, message: Column) -> list[Column]:
    return [
        F.lit(severity).alias("severity"),
        F.lit(code).alias("code"),
        (F.col(path) if isinstance(path, str) else path).alias("path"),
        F.lit(field).alias("field"),
        message.alias("message"),
    ]


def edge_issues(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Integrity of a graph: empty and repeated node ids, missing relations, empty and unknown endpoints."""
    ids = nodes.select("id").where("coalesce(id, '') != ''").distinct()
    ends = edges.select("id", "source", "relation", "target", F.posexplode(F.array("source", "target")).alias("k", "end"))
    ends = ends.withColumn("__field", F.when(F.col("k") == 0, "source").otherwise("target"))
    empty = ends.where("coalesce(end, '') = ''")
    known = ids.withColumnRenamed("id", "end")
    unknown = lookup_join(ends.where("coalesce(end, '') != ''"), known, ["end"], ["id", "k"], "left_anti")
    parts = [
        nodes.where("coalesce(id, '') = ''").select(
            *issue("critical", "GRAPH_NODE_ID_MISSING", F.coalesce("node_type", F.lit("")), "id", F.lit("node without id"))
        ),
        nodes.where("coalesce(id, '') != ''").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(
            *issue("critical", "GRAPH_NODE_ID_DUPLICATE", "id", "id", F.concat(F.col("n").cast("string"), F.lit(" nodes")))
        ),
        edges.where("coalesce(relation, '') = ''").select(
            *issue("critical", "GRAPH_EDGE_RELATION_MISSING", "id", "relation", F.lit("edge without relation"))
        ),
        empty.select(*issue("critical", "GRAPH_EDGE_ENDPOINT_EMPTY", "id", "endpoint", F.col("__field"))),
        unknown.select(*issue("critical", "GRAPH_EDGE_ENDPOINT_MISSING", "id", "endpoint", F.col("end"))),
    ]
    return reduce(DataFrame.unionByName, parts)


def related(edges: DataFrame, generic: str = "related_to") -> DataFrame:
    """entity_id, other_id, relations: neighbours in either direction, the generic relation only if it is the only one."""
    both = edges.select(F.col("source").alias("entity_id"), F.col("target").alias("other_id"), "relation").unionByName(
        edges.select(F.col("target").alias("entity_id"), F.col("source").alias("other_id"), "relation")
    )
    kinds = F.array_sort(F.collect_set("relation"))  # bounded by the vocabulary of relations
    grouped = both.where("entity_id != other_id").groupBy("entity_id", "other_id").agg(kinds.alias("r"))
    rel = F.when(F.size("r") > 1, F.array_remove("r", generic)).otherwise(F.col("r"))
    return grouped.select("entity_id", "other_id", rel.alias("relations"))


def first_related(edges: DataFrame, types: DataFrame, wanted: str, priority: list[str]) -> DataFrame:
    """source, target: per source the first target of the wanted type, by relation priority, order and id.

    ``edges``: source, relation, target, ord.  ``types``: id, node_type.
    Relations outside ``priority`` come last.
    """
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, priority)), F.col("relation")), F.lit(0))
    rank = F.when(rank == 0, F.lit(len(priority) + 1)).otherwise(rank)
    of_type = types.where(F.col("node_type") == wanted).select(F.col("id").alias("target")).distinct()
    found = lookup_join(edges.where("source != target"), of_type, ["target"], ["source", "ord"], "left_semi")
    return found.groupBy("source").agg(F.min_by("target", F.struct(rank, "ord", "target")).alias("target"))


def claim_plan(anchors: DataFrame, supports: DataFrame) -> DataFrame:
    """entity_id, claim_id, n_evidence, resolved: the evidence of each claim and whether its anchor exists.

    ``supports``: entity_id, claim_id, evidence_id.  ``anchors``: entity_id,
    claim_id, one row per accepted anchor; only a single anchor resolves.  If
    there is a column ``text``, that of the anchor's block, it must not be
    empty.  Rows whose column ``reserved`` is true are no anchors but ids that
    the entity's page uses itself; no anchor of that id resolves.
    """
    empty = F.col("text") == "" if "text" in anchors.columns else F.lit(False)
    reserved = F.col("reserved") if "reserved" in anchors.columns else F.lit(False)
    counted = anchors.groupBy("entity_id", "claim_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(reserved | empty).alias("n_unfit"))
    single = counted.where("n = 1 and n_unfit = 0").drop("n", "n_unfit")
    claims = supports.groupBy("entity_id", "claim_id").agg(F.count_distinct("evidence_id").alias("n_evidence"))
    return claims.join(single.withColumn("resolved", F.lit(True)), ["entity_id", "claim_id"], "left").fillna(
        False, ["resolved"]
    )


def layers(edges: DataFrame, source: str = "source", target: str = "target") -> DataFrame:
    """node, depth: longest path from a node without predecessor; nodes of or behind a cycle get null.

    Rounds take off all nodes whose predecessors are gone, until none goes, so
    there are as many rounds as layers; lineage is cut each round.
    """
    edges = cut_lineage(edges.select(F.col(source).alias("a"), F.col(target).alias("b")).where("a is not null and b is not null").distinct())
    left = cut_lineage(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct())
    done = []
    for depth in count():
        blocked = edges.join(left, edges["a"] == left["node"], "left_semi").select(F.col("b").alias("node")).distinct()
        free = cut_lineage(left.join(blocked, "node", "left_anti"))
        if free.isEmpty():
            break
        done.append(free.withColumn("depth", F.lit(depth)))
        left = cut_lineage(left.join(free, "node", "left_anti"))
    rest = left.withColumn("depth", F.lit(None).cast("int"))
    return reduce(DataFrame.unionByName, [*done, rest])
