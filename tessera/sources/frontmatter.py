"""Front-mattered documents: a restricted YAML header and a Markdown body.

The header knows mappings, lists, flow values, quoted and bare scalars and
block scalars.  Dates stay text.  Tags, anchors, aliases, tabs in the
indentation and repeated keys are errors.  Parsing runs in Arrow batches and
gives JSON text, which ``from_json`` or ``parse_json`` types afterwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the header's grammar.
NULLS = ("null", "Null", "NULL", "~")
BLOCKS = ("|", ">", "|-", ">-", "|+", ">+")
_ATOM = re.compile(r'"(?:\\.|[^"\\])*"?|\'[^\']*\'?|.', re.S)
_INT = re.compile(r"[-+]?\d+")
_FLOAT = re.compile(r"[-+]?(?:\d+\.\d*|\.\d+)")


class HeaderError(ValueError):
    """A header that does not follow the grammar."""


def _top_level(text: str, stop: str, nested: bool = True) -> Iterator[int]:
    """Places of a character outside quotes and, if ``nested``, outside brackets."""
    depth = 0
    for m in _ATOM.finditer(text):
        piece = m.group()
        if nested and piece in ("[", "{", "("):
            depth += 1
        elif nested and piece in ("]", "}", ")"):
            depth = max(0, depth - 1)
        elif piece == stop and depth == 0:
            yield m.start()


def _uncommented(text: str) -> str:
    for at in _top_level(text, "#"):
        if at == 0 or text[at - 1].isspace():
            return text[:at].rstrip()
    return text.rstrip()


def _flow_parts(inner: str) -> list[str]:
    cuts = [-1, *_top_level(inner, ","), len(inner)]
    parts = (inner[a + 1 : b].strip() for a, b in zip(cuts, cuts[1:], strict=False))
    return [p for p in parts if p]


def _pair(text: str, where: str) -> tuple[str, str]:
    at = next(_top_level(text, ":", nested=False), None)
    if at is None:
        raise HeaderError(f"{where}: expected ':'")
    key = text[:at].strip()
    if not key:
        raise HeaderError(f"{where}: empty key")
    return key, text[at + 1 :].strip()


def scalar(text: str):
    """Value of a scalar or flow collection."""
    text = _uncommented(text).strip()
    first, last = text[:1], text[-1:]
    if text == "":
        return ""
    if text in NULLS:
        return None
    if text.lower() in ("true", "false"):
        return text.lower() == "true"
    if first == last == '"':
        try:
            return json.loads(text)
        except json.JSONDecodeError as e:
            raise HeaderError(f"bad quoted text: {e}") from e
    if first == last == "'":
        return text[1:-1].replace("''", "'")
    if first == "[" and last == "]":
        return [scalar(p) for p in _flow_parts(text[1:-1])]
    if first == "{" and last == "}":
        out: dict = {}
        for key, value in (_pair(p, "flow mapping") for p in _flow_parts(text[1:-1])):
            _put(out, str(scalar(key)), scalar(value), "flow mapping")
        return out
    if _INT.fullmatch(text):
        return int(text)
    if _FLOAT.fullmatch(text):
        return float(text)
    if first in ("!", "&", "*"):
        raise HeaderError("tags, anchors and aliases are not supported")
    return text


def _put(mapping: dict, key: str, value, where: str) -> None:
    if key in mapping:
        raise HeaderError(f"{where}: key '{key}' is repeated")
    mapping[key] = value


class _Block:
    """A line and the more deeply indented lines under it."""

    def __init__(self, indent: int, text: str, line: int):
        self.indent, self.text, self.line = indent, text, line
        self.under: list[_Block] = []

    @property
    def where(self) -> str:
        return f"line {self.line}"

    def flat(self) -> Iterator[_Block]:
        yield self
        for b in self.under:
            yield from b.flat()


def _tree(text: str, first_line: int) -> list[_Block]:
    """Lines as a forest by indentation; blank and comment lines are gone."""
    root = _Block(-1, "", 0)
    path = [root]
    for number, line in enumerate(text.splitlines(), first_line):
        bare = line.lstrip(" \t")
        if not bare.strip() or bare.startswith("#"):
            continue
        lead = line[: len(line) - len(bare)]
        if "\t" in lead:
            raise HeaderError(f"line {number}: tab in the indentation")
        block = _Block(len(lead), bare.rstrip(), number)
        while path[-1].indent >= block.indent:
            path.pop()
        path[-1].under.append(block)
        path.append(block)
    return root.under


def _children(blocks: list[_Block]):
    """Value of the lines under a key: a list if the first begins with -, else a mapping."""
    if not blocks:
        return None
    for b in blocks:
        if b.indent != blocks[0].indent:
            raise HeaderError(f"{b.where}: uneven indentation")
    if blocks[0].text.startswith("-"):
        for b in blocks:
            if not b.text.startswith("-"):
                raise HeaderError(f"{b.where}: expected a list item")
        return [_item(b) for b in blocks]
    out: dict = {}
    for b in _with_lists(blocks):
        key, value = _entry(b)
        _put(out, key, value, b.where)
    return out


def _with_lists(blocks: list[_Block]) -> list[_Block]:
    """A list may stand at the indentation of nothing but its own key; items without a key are errors."""
    for b in blocks:
        if b.text.startswith("-"):
            raise HeaderError(f"{b.where}: list item among keys")
    return blocks


def _entry(b: _Block) -> tuple[str, object]:
    key, rest = _pair(b.text, b.where)
    key = str(scalar(key))
    if rest in BLOCKS:
        return key, _block_text(b, rest)
    if rest:
        if b.under:
            raise HeaderError(f"{b.under[0].where}: unexpected indentation")
        return key, scalar(rest)
    return key, _children(b.under)


def _block_text(b: _Block, style: str) -> str:
    """Text lines under a key: | keeps the lines, > joins them, - drops the final line end."""
    inner = [x for u in b.under for x in u.flat()]
    if not inner:
        return ""
    margin = inner[0].indent
    joined = ("\n" if style[0] == "|" else " ").join(" " * (x.indent - margin) + x.text for x in inner)
    return joined if style.endswith("-") else joined + "\n"


def _item(b: _Block):
    rest = b.text[1:].strip()
    if not rest:
        return _children(b.under)
    try:
        key, value = _pair(rest, b.where)
    except HeaderError:
        if b.under:
            raise HeaderError(f"{b.under[0].where}: a scalar item has nothing under it") from None
        return scalar(rest)
    out: dict = {}
    key = str(scalar(key))
    under = b.under
    if value:
        out[key] = scalar(value)
    elif under:  # the first run of one indentation belongs to the key, a shallower rest continues the item
        own = [u for u in under if u.indent == under[0].indent]
        out[key], under = _children(own), under[len(own) :]
    else:
        out[key] = None
    for u in under:
        k, v = _entry(u)
        _put(out, k, v, u.where)
    return out


def parse_header(text: str, first_line: int = 2) -> dict:
    blocks = _tree(text, first_line)
    if not blocks:
        return {}
    if blocks[0].indent or blocks[0].text.startswith("-"):
        raise HeaderError(f"{blocks[0].where}: the header must be a mapping")
    return _children(blocks)


def parse_document(text: str) -> tuple[dict, str]:
    """(header, body) of a document; the header stands between two lines of ---."""
    text = text.lstrip("\ufeff")
    lines = text.splitlines(keepends=True)
    marks = [k for k, line in enumerate(lines) if line.strip() == "---"][:2]
    if not marks or marks[0] != 0:
        raise HeaderError("no header")
    if len(marks) < 2:
        raise HeaderError("the header does not end")
    return parse_header("".join(lines[1 : marks[1]])), "".join(lines[marks[1] + 1 :])


def dump_header(data: dict) -> str:
    """Header text of a mapping; parsing it gives the mapping back."""
    return "".join(f"{line}\n" for line in _mapping_lines(data, 0))


def _quoted(text: str) -> str:
    """Double-quoted text on one line."""
    line_ends = {c: f"\\u{ord(c):04x}" for c in "\x85\u2028\u2029"}
    return json.dumps(text, ensure_ascii=False).translate(str.maketrans(line_ends))


def _scalar_text(value) -> str:
    if value is None or isinstance(value, bool):
        return {None: "null", True: "true", False: "false"}[value]
    return str(value) if isinstance(value, (int, float)) else _quoted(str(value))


def _key_lines(key: str, value, pad: str, deeper: int) -> Iterator[str]:
    key = key if re.fullmatch(r"[\w가-힣][\w가-힣 -]*", key) and isinstance(scalar(key), str) else _quoted(key)
    if isinstance(value, dict) and value:
        yield f"{pad}{key}:"
        yield from _mapping_lines(value, deeper)
    elif isinstance(value, list) and value:
        yield f"{pad}{key}:"
        yield from _list_lines(value, deeper)
    else:
        yield f"{pad}{key}: " + ("{}" if value == {} and isinstance(value, dict) else "[]" if isinstance(value, list) else _scalar_text(value))


def _mapping_lines(mapping: dict, indent: int) -> Iterator[str]:
    for key, value in mapping.items():
        yield from _key_lines(str(key), value, " " * indent, indent + 2)


def _list_lines(values: list, indent: int) -> Iterator[str]:
    pad = " " * indent
    for value in values:
        if isinstance(value, dict) and value:
            yield f"{pad}-"
            yield from _mapping_lines(value, indent + 2)
        elif isinstance(value, list) and value:
            yield f"{pad}-"
            yield from _list_lines(value, indent + 2)
        else:
            yield f"{pad}- " + ("{}" if isinstance(value, dict) else "[]" if isinstance(value, list) else _scalar_text(value))


_TYPES = {type(None): "null", bool: "bool", str: "string", int: "int", float: "float", list: "list", dict: "map"}
PARSED = "header string, body string, error string, present_keys array<string>, type_tags map<string,string>"


def parse_documents(df: DataFrame, column: str = "text") -> DataFrame:
    """``df`` with header (JSON), body, error, present_keys and type_tags (of the top level).

    A text that does not parse, or null, has an error and nothing else.
    Columns of these names are replaced.
    """
    made = [x.split()[0] for x in PARSED.split(", ")]
    df = df.drop(*[c for c in made if c != column])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + PARSED
    at = df.columns.index(column)
    names = [*df.columns, *made]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(at).to_pylist():
                try:
                    if text is None:
                        raise HeaderError("no text")
                    data, body = parse_document(text)
                    tags = {k: _TYPES[type(v)] for k, v in data.items()}
                    rows.append((json.dumps(data, ensure_ascii=False), body, None, list(data), list(tags.items())))
                except (HeaderError, RecursionError) as e:
                    rows.append((None, None, str(e), None, None))
            types = (pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.map_(pa.string(), pa.string()))
            made_ = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made_], names=names)

    return df.mapInArrow(run, schema)


def render_documents(df: DataFrame, header: str = "header", body: str = "body", text: str = "rendered") -> DataFrame:
    """``df`` with the document text of a JSON header and a body."""
    @F.pandas_udf("string")
    def render(h: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(
            [None if x is None else f"---\n{dump_header(json.loads(x))}---\n{y or ''}" for x, y in zip(h, b, strict=True)]
        )

    return df.withColumn(text, render(header, body))


def read_documents(spark: SparkSession, root: str) -> DataFrame:
    """path, text of every Markdown file under a folder, hidden folders and logs left out."""
    files = spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
    path = F.regexp_replace(F.col("_metadata.file_path"), r"^file:/*", "/")
    inner = F.substring(path, len(root.rstrip("/")) + 2, 1 << 20)
    return (
        files.select(F.url_decode(inner).alias("path"), F.col("value").alias("text"))
        .where(~F.col("path").rlike(r"(^|/)\.") & ~F.col("path").rlike(r"(^|/)logs/") & ~F.lower("path").rlike(r"(^|/)(agents|index)\.md$"))
    )


def load_entities(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(records, issues) of a folder: parsed documents, and an issue per document without a usable header."""
    from ..operators.graph import issue

    parsed = parse_documents(read_documents(spark, root))
    kind = F.get_json_object("header", "$.entity_type")
    broken = parsed.where("error is not null").select(
        *issue("critical", "FRONTMATTER_PARSE", "path", "frontmatter", F.col("error"))
    )
    untyped = parsed.where(F.col("error").isNull() & (F.trim(F.coalesce(kind, F.lit(""))) == "")).select(
        *issue("high", "ENTITY_TYPE_MISSING", "path", "entity_type", F.lit("no entity_type"))
    )
    good = parsed.where(F.col("error").isNull() & (F.trim(F.coalesce(kind, F.lit(""))) != ""))
    return good.drop("error"), broken.unionByName(untyped)
