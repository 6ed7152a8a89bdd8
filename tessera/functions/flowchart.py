"""Flowchart text as an edge list."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_NODE = r"([A-Za-z][\w-]*)(?:\s*(?:\[([^\]]*)\]|\(+([^)]*)\)+|\{([^}]*)\}))?"
_ARROW = re.compile(rf"\s*{_NODE}\s*(?:-->|---|-\.->|==>)\s*(?:\|([^|]*)\|\s*)?(?={_NODE})")
_LAST = re.compile(rf"\s*{_NODE}\s*;?\s*$")


def parse(source: str) -> list[tuple[str, str, str]]:
    """(source, target, label) of a flowchart; self loops and charts of fewer than two nodes are errors."""
    lines = [x.strip().rstrip(";") for x in source.splitlines() if x.strip() and not x.strip().startswith("%%")]
    if not lines or not re.match(r"(?:flowchart|graph)\b", lines[0]):
        raise ValueError("no flowchart")
    edges = []
    for line in lines[1:]:
        at, chain = 0, []
        while m := _ARROW.match(line, at):
            chain.append((m[1], m[5] or ""))
            at = m.end()
        last = _LAST.match(line, at)
        if not last:
            raise ValueError(f"not understood: {line}")
        ends = [n for n, _ in chain] + [last[1]]
        edges += [(a, b, label) for (a, label), b in zip(chain, ends[1:], strict=True)]
    if any(a == b for a, b, _ in edges):
        raise ValueError("self loop")
    if len({n for a, b, _ in edges for n in (a, b)}) < 2:
        raise ValueError("fewer than two nodes")
    return edges


_EDGES = "struct<edges:array<struct<source:string,target:string,label:string>>,error:string>"


def _parse_series(text: pd.Series) -> pd.DataFrame:
    rows = []
    for t in text:
        try:
            rows.append(([{"source": a, "target": b, "label": x} for a, b, x in parse(t or "")], None))
        except ValueError as e:
            rows.append(([], str(e)))
    return pd.DataFrame(rows, columns=["edges", "error"])


def flowchart_edges(text: Column | str) -> Column:
    """struct of edges and error of a flowchart's text; layers come from ``graph.layers``."""
    return F.pandas_udf(_parse_series, _EDGES)(text)
