"""Mapping free-entered values to a canonical list (problem 4).

Names and values are compared as their letters and digits in lower case.  A
multi-pattern automaton over all canonical names finds embedded mentions; the
longest one wins.  A value without a mention is compared by token-set
similarity: a name's tokens, in any order, are laid on the stretches of the
value's letters that fit them best, so that misplaced blanks, misspelt and
cut tokens cost only the letters concerned.  A second automaton over pieces of
the tokens says which names can come near a value at all; the others are
never compared with it.  A value that nothing fits stays 'unmatched'.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.norm import reference_key
from ..session import lookup_join
from . import codepoints

UNMATCHED = "unmatched"
#: Share of a name's letters that may be edited (one of three at least), also in a much longer value.
EDITS, EDITS_IN_LONG = 0.3, 0.12
#: A value much longer than a name has more than twice its letters and these.
LONG_BY = 8
#: A token may be cut to its first letters at the value's end; each letter cut costs a part of an edit.
#: So many letters of it stay at least, and so many and this share of the whole name.
CUT_LETTERS, CUT_COST, CUT_NAME_LETTERS, CUT_SHARE = 4, 0.3, 6, 0.5

_TOKEN = re.compile(r"[^\W_]+")


def compact(values: list[str]) -> list[str]:
    return codepoints.encode(*codepoints.letters_only(*codepoints.decode(pa.array(values, pa.string())))).to_pylist()


def tokens(value: str) -> list[str]:
    return _TOKEN.findall(unicodedata.normalize("NFKC", value).lower())


def _matrix(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(t) for t in texts])
    codes = np.zeros((int(size.max(initial=0)), len(texts)), dtype=np.uint32)
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), dtype=np.uint32)
    column = np.repeat(np.arange(len(texts)), size)
    codes[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), column] = flat
    return codes, size


def edit_distances(texts: list[str], pattern: str, free_ends: bool) -> np.ndarray:
    """Edits (insert, delete, change, swap of neighbours) from the pattern to each text.

    With free ends, to the best-fitting stretch of the text.  All texts at once.
    """
    if not texts:
        return np.zeros(0, dtype=np.int32)
    codes, size = _matrix(texts)
    length, n = codes.shape
    start = np.zeros(length + 1, np.int32) if free_ends else np.arange(length + 1, dtype=np.int32)
    rows = [np.repeat(start[:, None], n, axis=1)]
    for i, c in enumerate(map(ord, pattern), 1):
        above = rows[-1]
        row = np.empty_like(above)
        row[0] = i
        change = above[:-1] + (codes != c)
        if i > 1:
            swap = (codes[:-1] == c) & (codes[1:] == ord(pattern[i - 2]))
            change[1:] = np.where(swap, np.minimum(change[1:], rows[-2][:-2] + 1), change[1:])
        best = np.minimum(change, above[1:] + 1)
        for j in range(length):
            row[j + 1] = np.minimum(best[j], row[j] + 1)
        rows = [above, row]
    last = rows[-1]
    if not free_ends:
        return last[size, np.arange(n)]
    beyond = np.arange(length + 1)[:, None] > size[None, :]
    return np.where(beyond, np.int32(1 << 30), last).min(axis=0)


def pieces(parts: list[str], edits: int) -> set[str]:
    """Stretches of a name's tokens of which one is left whole by so many edits.

    Each edit touches one stretch only: for a swap across the border of two,
    both are also listed with the neighbour's letter.
    """
    size = max(1, sum(map(len, parts)) // (edits + 1))
    out: set[str] = set()
    for part in parts:
        n = -(-len(part) // size)
        at = [len(part) * k // n for k in range(n + 1)]
        for a, b in zip(at, at[1:], strict=False):
            heads = {part[a : a + 1]} | ({part[a - 1]} if a else set())
            tails = {part[b - 1 : b]} | ({part[b]} if b < len(part) else set())
            if b - a == 1:
                out |= heads | tails
            else:
                out |= {h + part[a + 1 : b - 1] + t for h in heads for t in tails}
        if len(part) > CUT_LETTERS:
            out.add(part[:CUT_LETTERS])
    return out


def allowed_edits(letters: int) -> int:
    return max(int(EDITS * letters), int(letters >= 3))


class Matcher:
    """Names of a reference list, ready for batches of values."""

    def __init__(self, names: list[tuple[str, str]]):
        """``names``: (canonical id, name); an id may have several names."""
        names = sorted({(i, n) for i, n in names if i and n})
        forms = compact([n for _, n in names])
        kept = [(i, n, f) for (i, n), f in zip(names, forms, strict=True) if f]
        self.ids = [i for i, _, _ in kept]
        self.forms = [f for _, _, f in kept]
        self.parts: list[str] = []
        self.tokens: list[list[int]] = []  # of each name, its distinct tokens
        place: dict[str, int] = {}
        self.automaton, self.near = ahocorasick.Automaton(), ahocorasick.Automaton()
        of_piece: dict[str, list[int]] = {}
        for c, (i, n, form) in enumerate(kept):
            if form not in self.automaton:  # of equal names the smallest id counts
                self.automaton.add_word(form, (len(form), i))
            own = [t for t in compact(tokens(n)) if t] or [form]
            own = list(dict.fromkeys(own))
            self.tokens.append([place.setdefault(t, len(place)) for t in own])
            for piece in pieces(own, allowed_edits(sum(map(len, own)))):
                of_piece.setdefault(piece, []).append(c)
        self.parts = list(place)
        for piece, at in of_piece.items():
            self.near.add_word(piece, np.array(at))
        if kept:
            self.automaton.make_automaton()
            self.near.make_automaton()

    def mention(self, form: str) -> tuple[int, int, str] | None:
        """(letters, place, id) of the longest mention; of equally long ones the first."""
        best: tuple[int, int, str] | None = None
        for end, (size, name_id) in self.automaton.iter(form):
            if best is None or (-size, end - size) < (-best[0], best[1]):
                best = size, end - size + 1, name_id
        return best

    def match(self, values: list[str]) -> list[tuple[str, float, int, int]]:
        """(canonical id or 'unmatched', similarity, letters and place of the mention or 0) of each value."""
        forms = compact(values)
        out: list[tuple[str, float, int, int]] = [(UNMATCHED, 0.0, 0, 0)] * len(values)
        if not self.forms:
            return out
        rest = []
        for k, form in enumerate(forms):
            if not form:
                continue
            if found := self.mention(form):
                out[k] = found[2], 1.0, found[0], found[1]
            else:
                rest.append(k)
        rest.sort(key=lambda k: len(forms[k]))
        a = 0
        while a < len(rest):  # blocks of similar length, so that a long text stands alone
            b = a + 1
            while b < len(rest) and b - a < 2048 and len(forms[rest[b]]) * (b - a) < 400_000:
                b += 1
            for k, found in zip(rest[a:b], self._similar([forms[k] for k in rest[a:b]]), strict=True):
                out[k] = *found, 0, 0
            a = b
        return out

    def near_names(self, form: str) -> np.ndarray:
        """Names of which the form holds a piece."""
        hits = {id(at): at for _, at in self.near.iter(form)}
        return np.unique(np.concatenate(list(hits.values()))) if hits else np.zeros(0, int)

    def _similar(self, forms: list[str]) -> list[tuple[str, float]]:
        """Id and token-set similarity of each form's nearest name, compared only with names it shares a piece with."""
        asked: dict[int, list[int]] = {}  # token: forms to lay it on
        near = []
        for k, form in enumerate(forms):
            near.append(self.near_names(form))
            for t in {t for c in near[k] for t in self.tokens[c]}:
                asked.setdefault(t, []).append(k)
        cost: dict[tuple[int, int], float] = {}
        cut: dict[tuple[int, int], int] = {}  # letters of a token that a value's end leaves off
        for t, at in asked.items():
            part = self.parts[t]
            far = edit_distances([forms[k] for k in at], part, free_ends=True)
            for k, d in zip(at, far, strict=True):
                cost[k, t] = min(int(d), len(part))
                if d:
                    kept = next((n for n in range(len(part) - 1, CUT_LETTERS - 1, -1) if forms[k].endswith(part[:n])), 0)
                    if kept and CUT_COST * (len(part) - kept) < d:
                        cut[k, t] = len(part) - kept
        out = []
        for k, form in enumerate(forms):
            best = (0.0, UNMATCHED)
            for c in near[k]:
                own = self.tokens[c]
                m = sum(len(self.parts[t]) for t in own)
                edits = sum(cost[k, t] for t in own)
                off = max((t for t in own if (k, t) in cut), key=lambda t: cost[k, t] - CUT_COST * cut[k, t], default=None)
                if off is not None and m - cut[k, off] >= max(CUT_NAME_LETTERS, CUT_SHARE * m):
                    edits += CUT_COST * cut[k, off] - cost[k, off]
                limit = int(EDITS_IN_LONG * m) if len(form) > 2 * m + LONG_BY else allowed_edits(m)
                if edits <= limit and (-(1 - edits / m), self.ids[c]) < (-best[0], best[1]):
                    best = 1 - edits / m, self.ids[c]
            out.append((best[1], best[0]))
        return out


_MATCHED = "list_name string, value string, canonical_id string, similarity double, mention int, place int"


def match_values(values: DataFrame, names: DataFrame, block: int = 20_000) -> DataFrame:
    """list_name, value, canonical_id, similarity, way of every distinct value.

    ``values``: list_name, value.  ``names``: list_name, canonical_id, name.
    Null and blank values are left out.  The longest mention wins, of equally
    long ones the first; without a mention the most similar name; of equals
    the first in the order of ids.  ``way`` is mention, token_set or none.
    The names go to the tasks in blocks of at most ``block`` names; a block's
    answers carry all that the choice looks at, so that the number of blocks
    changes nothing.
    """
    values = values.select("list_name", "value").where(F.coalesce(reference_key("value"), F.lit("")) != "").distinct()
    names = names.select("list_name", "canonical_id", "name").distinct()
    blocks = max(1, -(-names.count() // block))
    place = F.pmod(F.xxhash64("canonical_id"), F.lit(blocks))
    found = None
    for k in range(blocks):
        part = [tuple(r) for r in names.where(place == k).collect()]
        shared = values.sparkSession.sparkContext.broadcast(part)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lists: dict[str, list[tuple[str, str]]] = {}
            for list_name, canonical_id, name in shared.value:
                lists.setdefault(list_name, []).append((canonical_id, name))
            matchers = {n: Matcher(x) for n, x in lists.items()}
            for batch in batches:
                names_, texts = (c.to_pylist() for c in batch.columns)
                result: list = [(UNMATCHED, 0.0, 0, 0)] * len(texts)
                for n, matcher in matchers.items():
                    at = [i for i, x in enumerate(names_) if x == n]
                    for i, r in zip(at, matcher.match([texts[i] for i in at]), strict=True):
                        result[i] = r
                ids, similarity, mention, start = zip(*result, strict=True) if result else ((), (), (), ())
                more = [pa.array(ids, pa.string()), pa.array(similarity, pa.float64()), pa.array(mention, pa.int32()), pa.array(start, pa.int32())]
                yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[x.split()[0] for x in _MATCHED.split(", ")])

        one = values.mapInArrow(run, _MATCHED)
        found = one if found is None else found.unionByName(one)
    if blocks > 1:
        order = F.struct(-F.col("mention"), "place", -F.col("similarity"), F.col("canonical_id") == UNMATCHED, "canonical_id")
        best = F.min_by(F.struct("canonical_id", "similarity", "mention"), order)
        found = found.groupBy("list_name", "value").agg(best.alias("b")).select("list_name", "value", "b.*")
    way = F.when(F.col("mention") > 0, "mention").when(F.col("canonical_id") != UNMATCHED, "token_set").otherwise("none")
    return found.select("list_name", "value", "canonical_id", "similarity", way.alias("way"))


def canonical_entries(entries: DataFrame, names: DataFrame, row: str) -> DataFrame:
    """row, field, pos, value, canonical_id, similarity, way of every entry that is no canonical id as stored.

    ``entries``: row, field, pos, list_name, value.  Null and blank entries and
    those equal to an id of their list are left out; repeated rows come out each.
    """
    ids = names.select("list_name", F.col("canonical_id").alias("value")).distinct()
    entries = entries.where(F.coalesce(reference_key("value"), F.lit("")) != "")
    entries = lookup_join(entries, ids, ["list_name", "value"], [row, "pos"], "left_anti")
    matched = match_values(entries, names)
    return lookup_join(entries, matched, ["list_name", "value"], [row, "pos"]).drop("list_name")
