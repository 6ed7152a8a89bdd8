"""Readers of registry, catalogue, log, raw and page files as DataFrames."""

from __future__ import annotations

import json
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.norm import basename, normalized_ref, scalar_text
from .frontmatter import HeaderError, parse_header

_RECORD = (
    "source_id string, title string, publisher string, source_type string, jurisdiction string, authority_level int, "
    "location struct<kind:string,path:string,url:string>"
)


class RegistryError(ValueError):
    """A registry that cannot be used; ``kind`` is missing, parse or type."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


def _path_column() -> Column:
    return F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/"))


def read_texts(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, text of every file under a folder, whole."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter=glob)
    return files.select(_path_column().alias("path"), F.col("value").alias("text"))


def read_binaries(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """path, size_bytes, content of every file under a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    return files.select(
        F.url_decode(F.regexp_replace("path", r"^file:/*", "/")).alias("path"), F.col("length").alias("size_bytes"), "content"
    )


def read_json(spark: SparkSession, path: str, schema: str, default: DataFrame | None = None) -> DataFrame:
    """A JSON document or array as rows; the default if the file is missing or no JSON."""
    from pyspark.errors import PySparkException

    try:
        df = spark.read.schema(f"{schema}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path, multiLine=True)
        bad = bool(df.where("__bad is not null").limit(1).collect())
    except PySparkException:
        bad = True
    if bad:
        if default is None:
            raise RegistryError("parse", f"{path} is missing or no JSON")
        return default
    return df.drop("__bad")


def read_jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects of a JSON-lines file; blank lines and lines that are no object are skipped."""
    lines = spark.read.text(path).where("trim(value) != ''")
    parsed = lines.select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("v"), F.trim("value").alias("t"))
    whole = F.try_parse_json(F.col("t")).isNotNull()
    return parsed.where(F.startswith(F.col("t"), F.lit("{")) & whole).select("v.*")


def qa_records(spark: SparkSession, path: str) -> DataFrame:
    """line, raw, is_json, is_object of each non-blank line of a QA catalogue, for checks by line."""
    text = spark.read.text(path, wholetext=True)
    lines = text.select(F.posexplode(F.split("value", "\r?\n")).alias("pos", "raw")).where("trim(raw) != ''")
    return lines.select(
        (F.col("pos") + 1).alias("line"),
        "raw",
        F.try_parse_json(F.col("raw")).isNotNull().alias("is_json"),
        (F.startswith(F.trim("raw"), F.lit("{")) & F.try_parse_json(F.col("raw")).isNotNull()).alias("is_object"),
    )


def registry_records(text: str | None) -> list[dict]:
    """Source records of a registry's text; raises with the kind of failure."""
    if text is None:
        raise RegistryError("missing", "no registry")
    try:
        data = parse_header(text, 1)
    except HeaderError as e:
        raise RegistryError("parse", str(e)) from e
    records = data.get("sources")
    if not isinstance(records, list) or not all(isinstance(r, dict) for r in records):
        raise RegistryError("type", "sources must be a list of mappings")
    return records


def read_registry(spark: SparkSession, path: str, tolerant: bool = False) -> DataFrame:
    """Source registry as a table, paths of the old format moved into the location.

    A registry is a small curated file, parsed on the driver.  Tolerant
    reading gives no rows where strict reading raises.
    """
    try:
        with open(path, encoding="utf-8-sig") as f:
            records = registry_records(f.read())
    except FileNotFoundError as e:
        records = []
        if not tolerant:
            raise RegistryError("missing", path) from e
    except RegistryError:
        records = []
        if not tolerant:
            raise
    rows = []
    for r in records:
        place = r.get("location") if isinstance(r.get("location"), dict) else {}
        path_, url = place.get("path") or r.get("path"), place.get("url")
        kind = place.get("kind") or ("path" if path_ else "url" if url else None)
        level = r.get("authority_level")
        text = [r.get(k) if isinstance(r.get(k), str) else None for k in ("source_id", "title", "publisher", "source_type", "jurisdiction")]
        rows.append((*text, level if isinstance(level, int) else None, (kind, path_, url)))
    return spark.createDataFrame(rows, _RECORD)


def alias_map(spark: SparkSession, text: str, key: str = "aliases") -> DataFrame:
    """alias, target of a map in a header-like text, both as normalised references."""
    pairs = parse_header(text, 1).get(key) or {}
    df = spark.createDataFrame([(str(a), str(b)) for a, b in pairs.items()], "alias string, target string")
    return df.select(normalized_ref("alias").alias("alias"), normalized_ref("target").alias("target"))


def vocabulary(spark: SparkSession, text: str) -> DataFrame:
    """field, value of a JSON object of lists."""
    data = json.loads(text)
    rows = [(f, str(v)) for f, values in data.items() if isinstance(values, list) for v in values]
    return spark.createDataFrame(rows, "field string, value string").distinct()


def known_source_ids(*tables: DataFrame) -> DataFrame:
    """Distinct non-blank source ids of several tables."""
    parts = [t.select(scalar_text("source_id").alias("source_id")) for t in tables]
    return reduce(DataFrame.unionByName, parts).where("source_id != ''").distinct()


def last_of_each(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key in an order; lookups in which a later record replaces an earlier one."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("v")).select(key, "v.*")


# Names and suffixes of files that are no sources.
_CONTROL_NAMES = (".ds_store", "thumbs.db", "desktop.ini", "agents.md", ".gitkeep", ".gitignore")
_TEMPORARY = (".tmp", ".part", ".crdownload", ".swp", ".bak")


def is_control_file(path: Column | str) -> Column:
    """Whether a path names a control or temporary file."""
    name = F.lower(basename(path))
    return name.isin(*_CONTROL_NAMES) | name.startswith("~$") | reduce(lambda a, b: a | b, [name.endswith(s) for s in _TEMPORARY])


def raw_files(files: DataFrame, include_hidden: bool = False, include_control: bool = False) -> DataFrame:
    """Rows of a file listing (path, ...) that are raw sources."""
    out = files if include_hidden else files.where(~F.col("path").rlike(r"(^|/)\.[^/]"))
    return out if include_control else out.where(~is_control_file("path"))


def raw_names(files: DataFrame) -> DataFrame:
    """name, path: the four names under which a raw file may be referred to."""
    whole = normalized_ref("path")
    without = F.regexp_replace(whole, r"\.[^./]+$", "")
    names = F.array_distinct(F.array(whole, basename(whole), without, basename(without)))
    return files.select("path", F.explode(names).alias("name")).where("name != ''").distinct()


def log_items(lines: DataFrame) -> DataFrame:
    """file, line_no, action, targets of the Action: and Target: lines of logs (file, line_no, text)."""
    item = lines.select(
        "file", "line_no",
        F.trim(F.regexp_extract("text", r"^\s*[-*]?\s*\**Action\**\s*:\s*\**\s*(.+?)\s*$", 1)).alias("action"),
        F.filter(
            F.transform(F.split(F.regexp_extract("text", r"^\s*[-*]?\s*\**Target\**\s*:\s*\**\s*(.+?)\s*$", 1), ";"), lambda v: F.trim(v)),
            lambda t: t != "",
        ).alias("targets"),
    )
    return item.where((F.col("action") != "") | (F.size("targets") > 0))
