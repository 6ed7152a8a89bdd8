"""Counts, digests and comparisons of key sets."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Severities from the worst to the least.
SEVERITIES = ("critical", "high", "medium", "low")


def union_issues(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def severity_rank(severity: Column | str) -> Column:
    c = F.col(severity) if isinstance(severity, str) else severity
    return F.array_position(F.array(*map(F.lit, SEVERITIES)), c).cast("int")


def ordered_issues(issues: DataFrame) -> DataFrame:
    return issues.orderBy(severity_rank("severity"), "code", "path", "message")


def severity_counts(spark: SparkSession, issues: DataFrame) -> DataFrame:
    """severity, n_issues of every severity, zeros included."""
    every = spark.createDataFrame([(s,) for s in SEVERITIES], "severity string")
    counts = issues.groupBy("severity").agg(F.count(F.lit(1)).alias("n"))
    return every.join(F.broadcast(counts), "severity", "left").select(
        "severity", F.coalesce("n", F.lit(0).cast("bigint")).alias("n_issues")
    )


def breaches(counts: DataFrame, threshold: str) -> bool:
    """Whether any issue is at least as severe as the threshold."""
    worst = SEVERITIES[: SEVERITIES.index(threshold) + 1]
    return not counts.where(F.col("severity").isin(*worst) & (F.col("n_issues") > 0)).isEmpty()


def facet_counts(df: DataFrame, facets: list[str], missing: str = "(none)") -> DataFrame:
    """facet, value, n_rows of several columns in one pass; null and blank values under ``missing``."""
    each = F.array(
        *[
            F.struct(F.lit(f).alias("facet"), F.coalesce(F.nullif(F.trim(F.col(f)), F.lit("")), F.lit(missing)).alias("value"))
            for f in facets
        ]
    )
    return df.select(F.explode(each).alias("e")).groupBy("e.facet", "e.value").agg(F.count(F.lit(1)).alias("n_rows"))


def set_digest(df: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """n_keys and digest: SHA-256 over the distinct keys' own SHA-256 values, combined per bucket in order.

    Buckets are the first four hex digits of a key's hash, each digested as a
    sorted list, and the digest of the buckets' digests is taken at the end;
    so neither the size of the set nor its order matters, and no task sees it
    whole.  Null counts as the text ''.
    """
    by = by or []
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    keys = df.select(*by, F.sha2(line, 256).alias("h")).distinct()
    bucket = keys.groupBy(*by, F.substring("h", 1, 4).alias("b")).agg(
        F.count(F.lit(1)).alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("d")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), "\n")
    return bucket.groupBy(*by).agg(F.sum("n").alias("n_keys"), F.sha2(joined, 256).alias("digest"))


def plain_digest(df: DataFrame, columns: list[str], limit: int = 1_000_000) -> tuple[int, str]:
    """Number of distinct keys and the SHA-256 of their sorted lines, columns parted by tabs.

    The digest of stored baselines, which are small; a larger set than
    ``limit`` is an error (use :func:`set_digest`).  Lines sort by code points.
    """
    line = F.concat_ws("\t", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])
    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).distinct()
    keys = rows.select(*columns, line.alias("line")).limit(limit + 1).collect()
    if len(keys) > limit:
        raise ValueError(f"more than {limit} keys")
    text = "\n".join(r["line"] for r in sorted(keys, key=lambda r: tuple(r)[:-1]))
    return len(keys), hashlib.sha256(text.encode()).hexdigest()


def compare_baseline(now: DataFrame, baseline: DataFrame, by: list[str]) -> DataFrame:
    """by, verdict: 'growth' (more keys), 'drift' (as many, other digest), 'shrunk' or 'same'."""
    old = baseline.select(*by, F.col("n_keys").alias("old_n"), F.col("digest").alias("old_digest"))
    return now.join(old, by, "left").select(
        *by,
        F.when(F.col("n_keys") > F.coalesce("old_n", F.lit(0)), "growth")
        .when((F.col("n_keys") == F.col("old_n")) & (F.col("digest") != F.col("old_digest")), "drift")
        .when(F.col("n_keys") < F.col("old_n"), "shrunk")
        .otherwise("same")
        .alias("verdict"),
    )


def diff(old: DataFrame, new: DataFrame, key: str, value: str) -> DataFrame:
    """key, change: added, removed or changed between two states with one row per key."""
    a = old.select(F.col(key), F.col(value).alias("__a"), F.lit(True).alias("__in_a"))
    b = new.select(F.col(key), F.col(value).alias("__b"), F.lit(True).alias("__in_b"))
    change = (
        F.when(F.col("__in_a").isNull(), "added").when(F.col("__in_b").isNull(), "removed")
        .when(~F.col("__a").eqNullSafe(F.col("__b")), "changed")
    )
    return a.join(b, key, "full").select(key, change.alias("change")).where("change is not null")


def manifest(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, media_type, size_bytes, sha256 and a fallback id of each file's content.

    The lines of text files end in LF before they are measured, whatever they
    end in as stored; ``content`` is binary or text, null counts as empty.
    """
    extension = F.lower(F.regexp_extract(F.col(path), r"\.([^./]+)$", 1))
    text = F.coalesce(F.col(content).cast("string"), F.lit(""))
    unix = F.replace(text, F.lit("\r\n"), F.lit("\n")).cast("binary")
    raw = F.coalesce(F.col(content).cast("binary"), F.lit("").cast("binary"))
    data = F.when(extension.isin(*TEXT_SUFFIXES), unix).otherwise(raw)
    media = F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), extension)
    return files.select(
        path,
        F.coalesce(media, F.lit("application/octet-stream")).alias("media_type"),
        F.octet_length(data).cast("bigint").alias("size_bytes"),
        F.sha2(data, 256).alias("sha256"),
        F.concat(F.lit("raw-"), F.substring(F.sha2(F.col(path), 256), 1, 12)).alias("path_id"),
    )


def with_source_ids(files: DataFrame, registered: DataFrame) -> DataFrame:
    """A manifest with source_id: the registered id of the path (the last registered wins), else the path's own id.

    ``registered``: path, source_id, ordinal.
    """
    known = registered.where("coalesce(source_id, '') != ''").groupBy("path").agg(F.max_by("source_id", "ordinal").alias("__id"))
    return files.join(known, "path", "left").withColumn("source_id", F.coalesce("__id", "path_id")).drop("__id", "path_id")


def registry_drift(registry: DataFrame, current: DataFrame) -> DataFrame:
    """id, verdict between a registry of ids (id, path, aliases) and the current records (id, path).

    'missing': a record that the registry lacks; 'path changed'; 'removed': a
    registered id that no record has and that is no alias of one.
    """
    old = registry.select("id", F.col("path").alias("__old"), F.lit(True).alias("__registered"))
    new = current.groupBy("id").agg(F.min("path").alias("__new")).withColumn("__current", F.lit(True))
    kept = registry.select(F.explode("aliases").alias("id")).distinct()
    both = old.join(new, "id", "full")
    verdict = (
        F.when(F.col("__registered").isNull(), "missing").when(F.col("__current").isNull(), "removed")
        .when(~F.col("__old").eqNullSafe(F.col("__new")), "path changed")
    )
    found = both.select("id", verdict.alias("verdict")).where("verdict is not null")
    return found.where("verdict != 'removed'").unionByName(found.where("verdict = 'removed'").join(kept, "id", "left_anti"))


# Suffixes of text files, and media types.
TEXT_SUFFIXES = ("csv", "css", "htm", "html", "js", "json", "jsonl", "md", "svg", "txt", "xml", "yaml", "yml")
MEDIA_TYPES = {
    "csv": "text/csv", "htm": "text/html", "html": "text/html", "json": "application/json", "md": "text/markdown",
    "pdf": "application/pdf", "png": "image/png", "txt": "text/plain", "hwp": "application/x-hwp",
}
