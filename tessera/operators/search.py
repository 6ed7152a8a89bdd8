"""Text search: index tables, a match language, BM25, additive scores, paging.

A written index is searched through the postings of the query's terms.  A
table without an index is searched by two scans: one computes the corpus
statistics of the query's terms (a single row), one scores; terms are counted
by string expressions on the folded text, so nothing but the scored rows is
shuffled.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import markup
from ..functions.norm import OPEN_END, UNKNOWN_START, scalar_text
from ..functions.text import search_hay, search_tokens
from ..session import cut_lineage

#: Buckets of a written index.
BUCKETS = 64
#: Fixed values of the ranking function.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def postings(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """term, row, field, tf, places: how often and where (from 0) each field of each row has a term."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), search_tokens(f).alias("t")) for f in fields])
    tokens = df.select(row, F.explode(each).alias("e")).select(row, "e.field", F.posexplode("e.t").alias("place", "term"))
    return tokens.groupBy("term", row, "field").agg(
        F.count(F.lit(1)).alias("tf"), F.array_sort(F.collect_list("place")).alias("places")  # a field's own terms at most
    )


def term_counts(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """term, field, n_rows, tf: rows and occurrences of each term, without the places."""
    each = F.array(*[F.struct(F.lit(f).alias("field"), search_tokens(f).alias("t")) for f in fields])
    tokens = df.select(row, F.explode(each).alias("e")).select(row, "e.field", F.explode("e.t").alias("term"))
    by_row = tokens.groupBy("term", row, "field").agg(F.count(F.lit(1)).alias("tf"))
    return by_row.groupBy("term", "field").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("tf").alias("tf"))


def _occurrences(hay: Column, needle: str) -> Column:
    return ((F.length(hay) - F.length(F.replace(hay, F.lit(needle), F.lit("")))) / len(needle)).cast("int")


def token_count(hay: Column) -> Column:
    """Terms in a folded text (see ``search_hay``): one gap less than it has gaps."""
    return _occurrences(hay, "  ") - 1


def document_stats(df: DataFrame, row: str, fields: list[str]) -> DataFrame:
    """row, n_tokens over all indexed fields."""
    return df.select(row, reduce(lambda a, b: a + b, [token_count(search_hay(f)) for f in fields]).alias("n_tokens"))


@dataclass(frozen=True)
class Phrase:
    """One or more consecutive terms, the last perhaps a prefix, perhaps in some fields only or at their start."""

    terms: tuple[str, ...]
    prefix: bool = False
    fields: tuple[str, ...] | None = None
    outside: bool = False  # the fields named are those left out
    first: bool = False

    def within(self, field: str) -> bool:
        return self.fields is None or (field in self.fields) != self.outside


_LEX = re.compile(r'\s*(?:"(?P<string>(?:[^"]|"")*)"|(?P<sign>[(){}:,*^+-])|(?P<word>\w+))')
_OPERATORS = ("AND", "OR", "NOT")


def parse_match(text: str) -> tuple:
    """Syntax tree of a query: ('and'|'or'|'not', a, b), ('near', phrases, distance) or ('phrase', Phrase).

    From the tightest to the loosest: phrases side by side (all of them must
    match), NOT, AND, OR; NOT groups from the left.  Only phrases and NEAR
    groups stand side by side: before and after a bracket an operator is due.
    A field, a set of fields in braces or either with a minus before it, and a
    colon, bind the phrase, NEAR group or bracket behind them.  A query
    without any term is an error.
    """
    items: list[tuple[str, str]] = []
    at = 0
    while text[at:].strip():
        m = _LEX.match(text, at)
        if not m:
            raise ValueError(f"query not understood at {text[at:]!r}")
        items.append((m.lastgroup or "", m[m.lastgroup or 0]))
        at = m.end()
    position = 0

    def kind(k: int = 0) -> str:
        """'string', 'word', a sign or an operator; '' at the end."""
        if position + k >= len(items):
            return ""
        group, value = items[position + k]
        return value if group == "sign" or (group == "word" and value in _OPERATORS) else group

    def take(*wanted: str) -> str:
        nonlocal position
        if kind() not in wanted:
            raise ValueError(f"{' or '.join(wanted)} expected, {kind() or 'end'} found")
        position += 1
        return items[position - 1][1]

    def columns() -> tuple[tuple[str, ...], bool] | None:
        """The fields before a colon, if the next items are such."""
        nonlocal position
        start = position
        outside = kind() == "-"
        position += outside
        names: list[str] = []
        if kind() == "{":
            position += 1
            while kind() in ("word", "string"):
                names.append(take("word", "string"))
            take("}")
        elif kind() in ("word", "string"):
            names.append(take("word", "string"))
        if names and kind() == ":":
            position += 1
            return tuple(names), outside
        if outside:
            raise ValueError("a field is due after -")
        position = start
        return None

    def phrase(bound) -> Phrase:
        nonlocal position
        first = kind() == "^"
        position += first
        terms = list(_terms(take("word", "string")))
        prefix = kind() == "*"
        position += prefix
        while kind() == "+" and not prefix:
            position += 1
            terms += _terms(take("word", "string"))
            prefix = kind() == "*"
            position += prefix
        return Phrase(tuple(terms), prefix, *(bound or (None, False)), first)

    def near(bound) -> tuple:
        nonlocal position
        if kind() == "word" and items[position] == ("word", "NEAR") and kind(1) == "(":
            position += 2
            phrases, distance = [phrase(bound)], 10
            while kind() not in (",", ")"):
                phrases.append(phrase(bound))
            if take(",", ")") == ",":
                distance = int(take("word"))
                take(")")
            return ("near", tuple(phrases), distance) if len(phrases) > 1 else ("phrase", phrases[0])
        return ("phrase", phrase(bound))

    def bind(tree: tuple, bound) -> tuple:
        """A bracket's tree within the fields: a phrase of its own fields keeps what both allow."""
        if tree[0] == "phrase":
            return ("phrase", _bound(tree[1], bound))
        if tree[0] == "near":
            return ("near", tuple(_bound(p, bound) for p in tree[1]), tree[2])
        return (tree[0], bind(tree[1], bound), bind(tree[2], bound))

    def operand() -> tuple:
        bound = columns()
        if kind() == "(":
            take("(")
            inner = either()
            take(")")
            return bind(inner, bound) if bound else inner
        tree = near(bound)
        while kind() not in ("", ")", *_OPERATORS):
            tree = ("and", tree, near(columns()))
        return tree

    def chain(operator: str, name: str, inner):
        def read() -> tuple:
            tree = inner()
            while kind() == operator:
                take(operator)
                tree = (name, tree, inner())
            return tree

        return read

    either = chain("OR", "or", chain("AND", "and", chain("NOT", "not", operand)))
    tree = either()
    if position != len(items):
        raise ValueError(f"{kind()} is out of place")
    return tree


def _bound(phrase: Phrase, bound: tuple[tuple[str, ...], bool]) -> Phrase:
    names, outside = bound
    if phrase.fields is None:
        return replace(phrase, fields=names, outside=outside)
    if phrase.outside and outside:
        return replace(phrase, fields=phrase.fields + names)
    if phrase.outside:
        return replace(phrase, fields=tuple(n for n in names if n not in phrase.fields), outside=False)
    return replace(phrase, fields=tuple(n for n in phrase.fields if (n in names) != outside))


def _terms(text: str) -> list[str]:
    """The index terms of a query text, as the tokeniser of the index makes them."""
    import unicodedata

    folded = "".join(
        unicodedata.normalize("NFD", c)[0] if "À" <= c < "ɐ" or "Ḁ" <= c < "ἀ" else c for c in text.lower()
    )
    return [t for t in re.split(r"[\W_]+", folded) if t]


def phrase_count(hay: Column, phrase: Phrase) -> Column:
    """How often a phrase stands in a folded text."""
    if not phrase.terms:
        return F.lit(0)
    needle = " " + "  ".join(phrase.terms) + ("" if phrase.prefix else " ")
    return F.startswith(hay, F.lit(" " + needle)).cast("int") if phrase.first else _occurrences(hay, needle)


def _let(value: Column, use) -> Column:
    """``use`` of a value that is computed once, also where ``use`` names it within a lambda."""
    return F.element_at(F.transform(F.array(value), lambda v: use(v)), 1)


def _together(places: list[Column], sizes: list[int], distance: int) -> Column:
    """Whether one occurrence of each phrase lies within a span of their tokens and ``distance`` more.

    ``places``: per phrase the numbers of its first tokens.  A span begins at an occurrence of one of them.
    """
    reach = sum(sizes) + distance
    inside = lambda at, a, n: F.exists(at, lambda s: (s >= a) & (s + n <= a + reach))
    every = lambda a: reduce(lambda x, y: x & y, [inside(p, a, n) for p, n in zip(places, sizes, strict=True)])
    return F.exists(F.flatten(F.array(*places)), every)


def _near(hay: Column, phrases: tuple[Phrase, ...], distance: int) -> Column:
    """Whether the phrases stand near each other in a folded text (see :func:`_together`)."""

    def starts(tokens: Column, p: Phrase) -> Column:
        n = len(p.terms)
        whole = n - 1 if p.prefix else n

        def hit(i: Column) -> Column:
            same = F.slice(tokens, i + 1, whole) == F.array(*map(F.lit, p.terms[:whole])) if whole else F.lit(True)
            return same & F.startswith(F.element_at(tokens, i + n), F.lit(p.terms[-1])) if p.prefix else same

        places = F.filter(F.sequence(F.lit(0), F.size(tokens) - n), hit)
        if p.first:
            places = F.filter(places, lambda i: i == 0)
        return F.when(F.size(tokens) >= n, places).otherwise(F.array().cast("array<int>"))

    # Only texts with all phrases are looked at token by token.
    some = reduce(lambda x, y: x & y, [phrase_count(hay, p) > 0 for p in phrases])
    sizes = [len(p.terms) for p in phrases]
    together = lambda at: _together([at[k] for k in range(len(phrases))], sizes, distance)
    spans = _let(F.split(F.trim(hay), "  "), lambda t: _let(F.array(*[starts(t, p) for p in phrases]), together))
    return F.when(some, spans).otherwise(F.lit(False))


def tokenised(df: DataFrame, fields: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """``df`` with a folded text per field, made once per row, and those columns by field.

    The texts come out of a generator of one row, which no filter and no
    projection above is pushed through; otherwise each use would fold again.
    """
    names = {f: f"__t_{k}" for k, f in enumerate(fields)}
    folded = F.inline(F.array(F.struct(*[search_hay(f).alias(n) for f, n in names.items()])))
    return df.select("*", folded), {f: F.col(n) for f, n in names.items()}


def _evaluated(tree: tuple, fields: list[str], has, near) -> Column:
    """A tree as a condition; ``has(phrase, field)`` and ``near(phrases, distance, field)`` decide its leaves."""
    some = lambda cs: reduce(lambda a, b: a | b, cs, F.lit(False))
    if tree[0] == "phrase":
        return some([has(tree[1], f) for f in fields if tree[1].within(f)])
    if tree[0] == "near":
        return some([near(tree[1], tree[2], f) for f in fields if all(p.within(f) for p in tree[1])])
    a, b = (_evaluated(t, fields, has, near) for t in tree[1:])
    return a & b if tree[0] == "and" else a | b if tree[0] == "or" else a & ~b


def matches(tree: tuple, fields: dict[str, Column]) -> Column:
    """Whether a row matches a parsed query; ``fields``: folded texts by name (see :func:`tokenised`)."""
    return _evaluated(
        tree, list(fields), lambda p, f: phrase_count(fields[f], p) > 0, lambda ps, n, f: _near(fields[f], ps, n)
    )


def every_phrase(tree: tuple) -> list[Phrase]:
    if tree[0] in ("phrase", "near"):
        return phrases_of(tree)
    return every_phrase(tree[1]) + every_phrase(tree[2])


def phrases_of(tree: tuple) -> list[Phrase]:
    if tree[0] == "phrase":
        return [tree[1]]
    if tree[0] == "near":
        return list(tree[1])
    left = phrases_of(tree[1])
    return left if tree[0] == "not" else left + phrases_of(tree[2])


def bm25(df: DataFrame, query: str, weights: dict[str, float], score: str = "rank") -> DataFrame:
    """Matching rows with their rank: negative, smaller is better.

    ``weights``: the indexed fields.  Statistics (rows, mean tokens, rows with
    the phrase) are of the whole of ``df``; filter the result, not the input.
    Null fields have no tokens; an empty table gives no rows.
    """
    tree = parse_match(query)
    phrases = list(dict.fromkeys(phrases_of(tree)))
    tokens, fields = tokenised(df, list(weights))
    size = reduce(lambda a, b: a + b, [token_count(t) for t in fields.values()])

    def hits(p: Phrase) -> list[tuple[float, Column]]:
        return [(weights[f], phrase_count(t, p)) for f, t in fields.items() if p.within(f)]

    some = lambda p: reduce(lambda a, b: a | b, [h > 0 for _, h in hits(p)], F.lit(False))
    stats = tokens.agg(
        F.count(F.lit(1)).alias("n"), F.avg(size).alias("mean"), *[F.count_if(some(p)).alias(f"n{k}") for k, p in enumerate(phrases)]
    ).first()
    held = [stats[f"n{k}"] for k in range(len(phrases))]
    rank = _rank(held, [hits(p) for p in phrases], stats["n"], stats["mean"] or 1.0, size)
    return tokens.where(matches(tree, fields)).withColumn(score, rank).select(*df.columns, score)


def _rank(held: list[int], hits: list[list[tuple[float, Column]]], total: int, mean: float, size: Column) -> Column:
    """Negative sum over the phrases; ``held``: rows with each, ``hits``: weight and count per field."""
    rank = F.lit(0.0)
    for n, counts in zip(held, hits, strict=True):
        idf = max(LEAST_IDF, math.log((total - n + 0.5) / (n + 0.5)))
        f = reduce(lambda a, b: a + b, [F.lit(w) * h for w, h in counts], F.lit(0.0))
        rank = rank + F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B + B * size / mean))
    return -rank


@dataclass(frozen=True)
class Index:
    """Tables of a written index: postings by bucket of the term, tokens per row."""

    postings: DataFrame
    stats: DataFrame
    row: str
    buckets: int


def open_index(spark: SparkSession, root: str, row: str = "chunk_row", buckets: int = BUCKETS) -> Index:
    """The index that ``sinks.writers.write_index`` wrote under ``root``, with the same number of buckets."""
    return Index(spark.read.parquet(f"{root}/postings"), spark.read.parquet(f"{root}/doc_stats"), row, buckets)


def _phrase_places(index: Index, phrase: Phrase, fields: list[str]) -> DataFrame:
    """row, field, places: where a phrase stands, from the postings of its terms only."""
    at = index.postings.where(F.col("field").isin(*[f for f in fields if phrase.within(f)]))
    parts = []
    shifted = lambda k: F.transform("places", lambda x: x - k)
    for k, term in enumerate(phrase.terms):
        if phrase.prefix and k == len(phrase.terms) - 1:
            own = at.where(F.startswith("term", F.lit(term)))
        else:  # a literal hash, so that only the term's bucket is read
            own = at.where((F.col("bucket") == F.pmod(F.xxhash64(F.lit(term)), F.lit(index.buckets)).cast("int")) & (F.col("term") == term))
        parts.append(own.select(index.row, "field", F.lit(k).alias("slot"), shifted(k).alias("places")))
    if len(parts) == 1 and not phrase.prefix:
        found = parts[0].select(index.row, "field", "places")
    else:  # per row and field at most one list for each term, and those of a prefix
        each = reduce(DataFrame.unionByName, parts).groupBy(index.row, "field", "slot").agg(F.flatten(F.collect_list("places")).alias("places"))
        met = each.groupBy(index.row, "field").agg(F.collect_list("places").alias("p")).where(F.size("p") == len(parts))
        joined = F.aggregate(F.slice("p", 2, F.lit(len(parts))), F.element_at("p", 1), lambda a, b: F.array_intersect(a, b))
        found = met.select(index.row, "field", joined.alias("places"))
    if phrase.first:
        found = found.select(index.row, "field", F.filter("places", lambda x: x == 0).alias("places"))
    return found.where(F.size("places") > 0)


def search_index(index: Index, query: str, weights: dict[str, float], score: str = "rank") -> DataFrame:
    """row and rank of the matching rows, as :func:`bm25` gives them, from the index alone.

    Only the buckets of the query's terms are read (of a prefix, the sorted
    row groups that hold it), the sizes of the rows and no text.
    """
    tree = parse_match(query)
    phrases = list(dict.fromkeys(every_phrase(tree)))
    scored = [phrases.index(p) for p in dict.fromkeys(phrases_of(tree))]
    fields = list(weights)
    parts = [_phrase_places(index, p, fields).withColumn("phrase", F.lit(k)) for k, p in enumerate(phrases) if p.terms]
    total = index.stats.agg(F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("mean")).first()
    if not parts or not total["n"]:
        return index.stats.select(index.row, F.lit(0.0).alias(score)).limit(0)
    long = reduce(DataFrame.unionByName, parts)
    name = lambda k, f: f"__{k}_{fields.index(f)}"
    wide = long.groupBy(index.row).agg(
        *[
            F.coalesce(F.first(F.when((F.col("phrase") == k) & (F.col("field") == f), F.col("places")), ignorenulls=True), F.array().cast("array<int>")).alias(name(k, f))
            for k in range(len(phrases)) for f in fields
        ]
    )
    wide = cut_lineage(wide)  # the counts of rows come before the scores
    count = lambda k, f: F.size(name(k, f))
    some = lambda k: reduce(lambda a, b: a | b, [count(k, f) > 0 for f in fields])
    held = wide.agg(*[F.count_if(some(k)).alias(f"n{k}") for k in scored]).first()
    place = {p: k for k, p in enumerate(phrases)}
    match = _evaluated(
        tree, fields, lambda p, f: count(place[p], f) > 0,
        lambda ps, n, f: _together([F.col(name(place[p], f)) for p in ps], [len(p.terms) for p in ps], n),
    )
    hits = [[(weights[f], count(k, f)) for f in fields if phrases[k].within(f)] for k in scored]
    found = wide.where(match).join(index.stats, index.row)
    rank = _rank([held[f"n{k}"] for k in scored], hits, total["n"], total["mean"] or 1.0, F.col("n_tokens"))
    return found.select(index.row, rank.alias(score))


def section_chunks(records: DataFrame, body: str, entity: str = "id") -> DataFrame:
    """chunk_id, entity_id, title, entity_type, status, legal_status, effective_from, effective_to, heading, content of every section.

    Ids are the record's and the section's number (``::section-001``); claim
    marks and markup are off the content.  Columns that ``records`` lacks, and
    values it leaves blank, get what stands for unknown: '' or unknown, the
    earliest start and the open end.  Null bodies give no chunk.
    """
    given = lambda c: scalar_text(c) if c in records.columns else F.lit("")
    known = lambda c, default: F.coalesce(F.nullif(given(c), F.lit("")), F.lit(default))
    each = records.select(
        F.col(entity).alias("entity_id"), given("title").alias("title"), given("entity_type").alias("entity_type"), given("status").alias("status"),
        known("legal_status", "unknown").alias("legal_status"), known("effective_from", UNKNOWN_START).alias("effective_from"),
        known("effective_to", OPEN_END).alias("effective_to"), F.posexplode(markup.section_list(body)).alias("__pos", "__s"),
    )
    number = F.format_string("%s::section-%03d", F.col("entity_id").cast("string"), F.col("__pos") + 1)
    return each.select(number.alias("chunk_id"), *[c for c in each.columns if not c.startswith("__")], "__s.heading", "__s.content")


def top_ranked(df: DataFrame, k: int, order: list) -> DataFrame:
    """The best ``k`` rows (at least one) in a total order."""
    return df.orderBy(*order).limit(max(1, k))


def snippet(content: Column, query: str, words: int = 24) -> Column:
    """Window of at most ``words`` words around the first hit, hits in brackets, cut ends marked."""
    terms = F.array(*[F.lit(t) for p in phrases_of(parse_match(query)) for t in p.terms])
    split = F.filter(F.split(F.coalesce(content, F.lit("")), r"\s+"), lambda w: w != "")
    hit = lambda w: F.arrays_overlap(search_tokens(w), terms)
    at = F.array_position(F.transform(split, hit), F.lit(True))
    start = F.greatest(F.lit(1).cast("bigint"), at - words // 3)
    cut = F.slice(split, start.cast("int"), F.lit(words))
    text = F.array_join(F.transform(cut, lambda w: F.when(hit(w), F.concat(F.lit("["), w, F.lit("]"))).otherwise(w)), " ")
    return F.concat(
        F.when(start > 1, " … ").otherwise(""), text, F.when(start + words - 1 < F.size(split), " … ").otherwise("")
    )


def fold_query(text: str) -> list[str]:
    """Terms of an additive search: compatibility form, lower case, middle dots as blanks."""
    import unicodedata

    return re.sub("[·ㆍ]", " ", unicodedata.normalize("NFKC", text).lower()).split()


def additive_score(terms: list[str], title: Column, aliases: Column, summary: Column, number: Column, text: Column) -> Column:
    """Sum over the terms of fixed points per kind of hit; -1 unless every term is in the text."""

    def points(term: str) -> Column:
        t = F.lit(term)
        return (
            F.when(number == t, 100).when(F.contains(number, t), 70).otherwise(0)
            + F.when(title == t, 80).when(F.startswith(title, t), 55).when(F.contains(title, t), 40).otherwise(0)
            + F.when(F.contains(aliases, t), 30).otherwise(0)
            + F.when(F.contains(summary, t), 12).otherwise(0)
            + F.when(F.contains(text, t), 3).otherwise(0)
        )

    if not terms:
        return F.lit(0)
    every = reduce(lambda a, b: a & b, [F.contains(text, F.lit(t)) for t in terms])
    return F.when(every, reduce(lambda a, b: a + b, [points(t) for t in terms])).otherwise(-1)


def page(df: DataFrame, number: int, size: int, order: list, deep: int = 100_000) -> DataFrame:
    """One page of an ordered result; a page beyond the last is the last, one before the first the first.

    Pages that begin behind the first ``deep`` rows are not reached by sorting
    all rows before them into one task: rows are range-partitioned over the
    order, counted per partition, and only the partitions of the page sorted.
    """
    total = df.count()
    last = max(1, -(-total // size))
    number = min(max(1, number), last)
    start = (number - 1) * size
    if start < deep:
        return df.orderBy(*order).offset(start).limit(size)
    keys = [F.col(o) if isinstance(o, str) else o for o in order]
    placed = cut_lineage(df.repartitionByRange(*keys).withColumn("__part", F.spark_partition_id()))
    counts = sorted((r["__part"], r["n"]) for r in placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, wanted, skipped = 0, [], 0
    for part, n in counts:  # one entry per partition
        if before < start + size and before + n > start:
            skipped = before if not wanted else skipped
            wanted.append(part)
        before += n
    return placed.where(F.col("__part").isin(*wanted)).drop("__part").orderBy(*order).offset(start - skipped).limit(size)
