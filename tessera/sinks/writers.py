"""Sinks: tables, JSON lines, reports, and writes that happen whole or not at all."""

from __future__ import annotations

import json
import os
import re
import shutil
import tempfile
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.search import BUCKETS, document_stats, postings


def inside(root: str, path: str) -> str:
    """Absolute output path; an error if it leaves the root.  A root with a scheme (file:, hdfs:) keeps it."""
    if re.match(r"[a-z][a-z0-9+.-]+:", root):
        if path.startswith("/") or ".." in path.split("/"):
            raise ValueError(f"{path} is outside {root}")
        return f"{root.rstrip('/')}/{path}"
    root, path = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if os.path.commonpath([root, path]) != root:
        raise ValueError(f"{path} is outside {root}")
    return path


def write_json(data, path: str) -> None:
    """A small report as readable JSON with LF line ends."""
    os.makedirs(os.path.dirname(path) or ".", exist_ok=True)
    with open(path, "w", encoding="utf-8", newline="\n") as f:
        f.write(json.dumps(data, ensure_ascii=False, indent=2) + "\n")


def json_lines(df: DataFrame) -> DataFrame:
    """value: each row as JSON with its keys in order and nulls kept."""
    return df.select(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def write_jsonl(df: DataFrame, path: str, order: list[str], one_file: bool = False) -> None:
    """JSON lines sorted by ``order``: range-sorted part files, or one file for a small result."""
    lines = df.orderBy(*order)
    out = json_lines(lines.coalesce(1) if one_file else lines)
    out.write.mode("overwrite").text(path)


def write_index(chunks: DataFrame, root: str, row: str = "chunk_row", fields: tuple[str, ...] = ("title", "heading", "content"), buckets: int = BUCKETS) -> None:
    """Search index as tables: chunks, postings (partitioned by a hash of the term) and document sizes."""
    chunks.write.mode("overwrite").parquet(inside(root, "chunks"))
    write_postings(chunks, root, row, fields, buckets)


def write_postings(chunks: DataFrame, root: str, row: str = "chunk_row", fields: tuple[str, ...] = ("title", "heading", "content"), buckets: int = BUCKETS) -> None:
    """The part of the index that ``operators.search.search_index`` reads, for chunks that are stored already."""
    rows = postings(chunks, row, list(fields)).withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int"))
    # Rebalanced, so that a bucket with a very frequent term is written by several tasks.
    rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(inside(root, "postings"))
    document_stats(chunks, row, list(fields)).write.mode("overwrite").parquet(inside(root, "doc_stats"))


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; more rows than ``limit`` are an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows")
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    head = [f"| {' | '.join(df.columns)} |", "|" + "---|" * len(df.columns)]
    return "\n".join([*head, *[f"| {' | '.join(map(cell, r))} |" for r in rows]]) + "\n"


def write_all(root: str, writes: dict[str, Callable[[str], None]], check: Callable[[str], None] | None = None) -> None:
    """Several outputs at once: written beside the root, checked, and then put in place; on failure nothing changes.

    For outputs on the driver's file system (reports, exports).  ``writes``:
    relative path and a function that writes to the path it is given.
    """
    os.makedirs(root, exist_ok=True)
    stage = tempfile.mkdtemp(prefix=".stage-", dir=root)
    moved: list[tuple[str, str | None]] = []
    try:
        for name, write in writes.items():
            target = inside(stage, name)
            os.makedirs(os.path.dirname(target), exist_ok=True)
            write(target)
        if check:
            check(stage)
        for name in writes:
            final, kept = inside(root, name), None
            os.makedirs(os.path.dirname(final), exist_ok=True)
            if os.path.lexists(final):
                kept = inside(stage, f".old-{len(moved)}")
                os.rename(final, kept)
            moved.append((final, kept))
            os.rename(inside(stage, name), final)
    except BaseException:
        for final, kept in reversed(moved):
            if os.path.lexists(final):
                shutil.rmtree(final) if os.path.isdir(final) else os.remove(final)
            if kept:
                os.rename(kept, final)
        raise
    finally:
        shutil.rmtree(stage, ignore_errors=True)
