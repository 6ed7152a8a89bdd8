"""Claim marks of pages and the evidence that supports them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import markup
from ..session import cut_lineage, lookup_join
from .graph import issue

VALID = "^[a-z][a-z0-9-]{0,63}$"


def marks(pages: DataFrame) -> DataFrame:
    """page, part, claim_id, line, text, accepted: every claim mark of the parts of pages.

    ``pages``: page, part, body.  A page's text may be stored in several
    parts; null bodies have no mark.
    """
    found = pages.select("page", "part", markup.claim_anchors("body").alias("a"))
    entry = lambda x, text, ok: F.struct(x["claim_id"].alias("claim_id"), x["line"].alias("line"), text.alias("text"), F.lit(ok).alias("accepted"))
    both = F.concat(
        F.transform("a.accepted", lambda x: entry(x, x["text"], True)), F.transform("a.rejected", lambda x: entry(x, F.lit(""), False))
    )
    return found.select("page", "part", F.inline(both))


def claim_rules(pages: DataFrame, supports: DataFrame, strict: bool = True) -> DataFrame:
    """Issues (severity, code, path, field, message) of claim marks and of evidence that names claims.

    ``pages``: page, part, title, body.  ``supports``: page, claim_id, one row
    per naming of a claim; repeats count once, blanks not at all.  Only a
    strict check wants a mark for each claim named and evidence for each mark.
    Pages that only ``supports`` names have no marks.
    """
    found = cut_lineage(marks(pages))  # read by several rules
    bad = ~F.col("claim_id").rlike(VALID)
    at = F.concat(F.col("page"), F.lit("/"), F.col("part").cast("string"), F.lit(":"), F.col("line").cast("string"))
    each = F.array_compact(F.array(
        F.when(bad, F.lit("CLAIM_ID_INVALID")), F.when(F.col("accepted") & (F.col("text") == ""), F.lit("CLAIM_BLOCK_EMPTY")),
        F.when(~F.col("accepted"), F.lit("CLAIM_MARKER_CONTEXT")),
    ))
    rows = found.select(F.lit("high").alias("severity"), F.explode(each).alias("code"), at.alias("path"), F.lit("body").alias("field"), F.col("claim_id").alias("message"))
    anchors = found.where("accepted").groupBy("page", "claim_id").agg(F.count(F.lit(1)).alias("n"))
    named = supports.where("trim(coalesce(claim_id, '')) != '' and page is not null").select("page", F.trim("claim_id").alias("claim_id")).distinct()
    heads = pages.select("page", F.explode(markup.heading_ids("body", "title")).alias("claim_id")).distinct()
    taken = lookup_join(anchors, heads, ["page", "claim_id"], ["claim_id"], "left_semi").unionByName(
        anchors.where(F.col("claim_id").isin(*markup.PAGE_IDS))
    ).distinct()
    of = lambda severity, code, field: issue(severity, code, "page", field, F.col("claim_id"))
    parts = [
        rows,
        named.where(bad).select(*of("high", "EVIDENCE_CLAIM_ID_INVALID", "evidence")),
        anchors.where("n > 1").select(*of("high", "CLAIM_ANCHOR_DUPLICATE", "body")),
        taken.select(*of("high", "CLAIM_FRAGMENT_COLLISION", "body")),
    ]
    if strict:
        lost = lookup_join(named, anchors.select("page", "claim_id"), ["page", "claim_id"], ["claim_id"], "left_anti")
        idle = lookup_join(anchors.where(~bad), named, ["page", "claim_id"], ["claim_id"], "left_anti")
        parts += [lost.select(*of("high", "EVIDENCE_CLAIM_UNRESOLVED", "evidence")), idle.select(*of("medium", "CLAIM_ANCHOR_UNREFERENCED", "body"))]
    return reduce(DataFrame.unionByName, parts)
