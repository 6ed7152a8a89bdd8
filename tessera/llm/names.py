"""Visually identical text with different characters (problem 3)."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..session import cut_lineage, lookup_join
from . import codepoints


def with_form(df: DataFrame, column: str, form: str = "form") -> DataFrame:
    """``df`` with one more column: the consistent form of a text column.

    Two texts look the same exactly if their forms are equal.  Case and every
    visible mark stay.  A null text has a null form, a text of characters that
    do not show has the form ''.  Texts of any length are taken whole.
    """
    schema = StructType([*df.schema.fields, StructField(form, StringType())])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = codepoints.look(batch.column(at))
            yield pa.RecordBatch.from_arrays([*batch.columns, made], names=[*batch.schema.names, form])

    return df.mapInArrow(run, schema)


def named_values(df: DataFrame, row: str, value: str, field: str, many: bool = False) -> DataFrame:
    """field, key, value: one row per non-null value, or per element of an array column."""
    each = F.explode(value) if many else F.col(value)
    return df.select(F.lit(field).alias("field"), F.col(row).alias("key"), each.alias("value")).where("value is not null")


def _digest(column: str):
    """Bounded stand-in of a text in joins and groups."""
    return F.unhex(F.sha2(column, 256))


def spelled(formed: DataFrame) -> DataFrame:
    """field, key, form, spelling: digests of form and value, one row each; forms that show nothing are left out."""
    made = formed.where("form != ''").select("field", "key", _digest("form").alias("form"), _digest("value").alias("spelling"))
    return made.distinct()


def spellings(rows: DataFrame) -> DataFrame:
    """field, form, spelling, n_rows of every spelling of a form that has several."""
    each = rows.groupBy("field", "form", "spelling").agg(F.count(F.lit(1)).alias("n_rows"))
    many = each.groupBy("field", "form").agg(F.count(F.lit(1)).alias("n_spellings")).where("n_spellings > 1")
    return lookup_join(each, many.select("field", "form"), ["field", "form"], ["spelling"], "left_semi")


def look_groups(formed: DataFrame) -> DataFrame:
    """field, form, n_rows, n_spellings of every form that more than one spelling has."""
    each = formed.groupBy("field", "form", "value").agg(F.count(F.lit(1)).alias("n"))
    return (
        each.groupBy("field", "form")
        .agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_spellings"))
        .where("n_spellings > 1")
    )


def look_members(formed: DataFrame) -> DataFrame:
    """field, key, class: of every row that has a look-alike, the class; rows of one class look the same.

    ``class`` is the digest of the form.  A row whose value looks like no
    other spelling has no class; one of several values can have several.
    """
    rows = spelled(formed)
    known = spellings(rows).select("field", "form").distinct()
    found = lookup_join(rows, known, ["field", "form"], ["key"])
    return found.select("field", "key", F.lower(F.hex("form")).alias("class")).distinct()


def look_alike_pairs(formed: DataFrame, hot_rows: int = 20_000) -> DataFrame:
    """field, key_a, key_b: different rows whose values look the same and differ in characters.

    Input: field, key, value, form.  Values that show nothing (form '') are no
    case, rows with equal characters are none either, a pair comes out once.
    Spellings are paired first, each standing for all its rows; the rows of
    the more frequent spelling of a pair are then laid to it, and to these the
    rows of the other.  So no pair of rows of one spelling is ever formed: the
    work is that of the pairs that come out.  Every join splits keys of more
    than ``hot_rows`` rows by salts.
    """
    rows = cut_lineage(spelled(formed))  # the texts are folded once for the uses below
    known = spellings(rows)
    # Of two spellings the more frequent stands first.
    order = known.select("field", "form", F.struct(-F.col("n_rows"), F.col("spelling")).alias("a"))
    paired = lookup_join(order, order.withColumnRenamed("a", "b"), ["field", "form"], ["a"], hot_rows=hot_rows).where("a < b")
    paired = paired.select("field", F.col("a.spelling").alias("first"), F.col("b.spelling").alias("second"))
    left = rows.select("field", F.col("spelling").alias("first"), F.col("key").alias("x"))
    half = lookup_join(left, paired, ["field", "first"], ["x"], hot_rows=hot_rows).select("field", "second", "x")
    right = rows.select("field", F.col("spelling").alias("second"), F.col("key").alias("y"))
    both = lookup_join(half, right, ["field", "second"], ["x"], hot_rows=hot_rows).where("x != y")
    return both.select("field", F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b")).distinct()
