"""Texts inside nested JSON values, and spellings of dates and labels."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _leaves(value) -> list[str]:
    if isinstance(value, dict):
        return [x for v in value.values() for x in _leaves(v)]
    if isinstance(value, list):
        return [x for v in value for x in _leaves(v)]
    if value is None or value == "":
        return []
    return [str(value).lower() if isinstance(value, bool) else str(value)]


def _leaf_series(text: pd.Series) -> pd.Series:
    out = []
    for t in text:
        try:
            out.append([] if t is None else _leaves(json.loads(t)))
        except ValueError:
            out.append([])
    return pd.Series(out, dtype=object)


def leaf_texts(json_text: Column | str) -> Column:
    """All scalar values in a JSON text as texts, in order; none for null or for no JSON."""
    return F.pandas_udf(_leaf_series, "array<string>")(json_text)


def dotted_date(day: Column | str) -> Column:
    """YYYY. M. D. of an ISO date text; other texts stay as they are."""
    c = F.col(day) if isinstance(day, str) else day
    short = F.concat_ws(
        ". ", F.substring(c, 1, 4), F.substring(c, 6, 2).cast("int").cast("string"), F.substring(c, 9, 2).cast("int").cast("string")
    )
    return F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}\z"), F.concat(short, F.lit("."))).otherwise(c)


def host_label(url: Column | str, labels: dict[str, str], default: str) -> Column:
    """Label of a URL by its host or a parent domain of it, the first that fits; ``default`` for others and for no URL."""
    c = F.col(url) if isinstance(url, str) else url
    host = F.lower(F.regexp_extract(F.coalesce(c, F.lit("")), r"^https?://(?:[^/@]*@)?([^/:?#]+)", 1))
    out = F.lit(default)
    for domain, label in reversed(labels.items()):
        out = F.when((host == domain) | F.endswith(host, F.lit("." + domain)), F.lit(label)).otherwise(out)
    return out
