"""Evaluation texts leaking into training text (problem 8).

Texts are reduced to letters and digits.  Winnowing keeps, of every window of
``span - gram + 1`` consecutive grams, the smallest gram hash; two texts that
share ``span`` characters share a whole window and so its smallest hash.
Equal fingerprints are then extended to the longest common run, which decides.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage, lookup_join
from . import codepoints

#: Letters or digits that a leak has at least, and the length of a gram.
SPAN, GRAM = 40, 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def gram_hashes(chars: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the gram that starts at each place; polynomial, built by doubling."""
    have, length, power = chars.astype(np.uint64) * _MIX, 1, _BASE
    have ^= have >> np.uint64(29)
    whole, whole_length = None, 0
    while length <= gram:
        if gram & length:
            if whole is None:
                whole, whole_length = have, length
            else:  # the longer part stands left
                n = len(whole) - length
                whole = have[: max(0, len(have) - whole_length)][: max(0, n)] * power_of(whole_length) + whole[length:][: max(0, n)]
                whole_length += length
        if len(have) <= length:
            have = have[:0]
        else:
            have = have[:-length] * power + have[length:]
        length *= 2
        power = power_of(length)
    whole = whole ^ (whole >> np.uint64(32))
    whole = whole * _MIX
    return whole ^ (whole >> np.uint64(29))


def power_of(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of ``width`` values."""
    done = 1
    while done * 2 <= width:
        x = np.minimum(x[:-done], x[done:])
        done *= 2
    rest = width - done
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def fingerprints(chars: np.ndarray, offsets: np.ndarray, span: int, gram: int):
    """(row, hash) of the winnowed fingerprints, and the hashes of all grams."""
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    if len(chars) < span:
        return none
    grams = gram_hashes(chars, gram)
    least = sliding_min(grams, span - gram + 1)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    first, last = row[: len(least)], row[span - 1 :]
    whole = first == last
    new = np.ones(len(least), dtype=bool)
    new[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1])
    new |= ~np.append(False, whole[:-1])
    at = np.flatnonzero(whole & new)
    return first[at], least[at], grams


class Items:
    """Evaluation texts ready for probing: letters, fingerprints and gram places of each."""

    def __init__(self, ids: list[int], texts: list[str], span: int, gram: int):
        self.ids, self.span, self.gram = np.array(ids, dtype=np.int64), span, gram
        self.chars, self.offsets = codepoints.letters_only(*codepoints.decode(pa.array(texts, pa.string())))
        row, hashes, grams = fingerprints(self.chars, self.offsets, span, gram)
        # Every place where a fingerprint's gram stands in an item, not only where its window chose it.
        n = max(0, len(self.chars) - gram + 1)
        owner = np.repeat(np.arange(len(ids)), np.diff(self.offsets))
        inside = owner[:n] == owner[gram - 1 :][:n] if n else np.zeros(0, bool)
        place = np.flatnonzero(inside & np.isin(grams[:n], hashes)) if len(hashes) else np.zeros(0, np.int64)
        order = np.argsort(grams[place], kind="stable") if len(place) else place
        self.place = place[order]
        self.hash = grams[self.place] if len(place) else np.zeros(0, np.uint64)
        self.item = owner[self.place] if len(place) else np.zeros(0, np.int64)
        self.runs = periodic_runs(self.hash, self.place, self.item, gram)
        self.run_item = owner[self.runs[0]] if len(place) else self.item

    def common_run(self, text: np.ndarray, at: int, place: int, item: int) -> tuple[int, int]:
        """Letters of the common run before text[at] and the item's ``place``, and from there on."""
        a, b = self.offsets[item], self.offsets[item + 1]
        left = min(at, place - a)
        right = min(len(text) - at, b - place)
        back = text[at - left : at] != self.chars[place - left : place]
        ahead = text[at : at + right] != self.chars[place : place + right]
        before = left - 1 - np.flatnonzero(back)[-1] if back.any() else left
        after = np.flatnonzero(ahead)[0] if ahead.any() else right
        return int(before), int(after)

    def leaks(self, chars: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        """(row, item index, longest common run) with a run of ``span`` at least."""
        if not len(self.hash):
            return []
        row, hashes, grams = fingerprints(chars, offsets, self.span, self.gram)
        known = np.unique(self.hash)
        found = known[np.minimum(np.searchsorted(known, hashes), len(known) - 1)] == hashes
        if not found.any():
            return []
        best: dict[tuple[int, int], int] = {}
        wanted = np.unique(hashes[found])
        for r in np.unique(row[found]):
            text = chars[offsets[r] : offsets[r + 1]]
            own = grams[offsets[r] : offsets[r] + len(text) - self.gram + 1]
            at = np.flatnonzero(np.isin(own, wanted))
            at = at[np.argsort(own[at], kind="stable")]
            ours = periodic_runs(own[at], at, np.zeros(len(at), np.int64), self.gram)
            covered: dict[tuple[int, int], tuple[int, int]] = {}  # of a diagonal, the last run looked at
            for first, last, step, value in sorted(zip(*ours, strict=True)):
                a = np.searchsorted(self.runs[3], value)
                b = np.searchsorted(self.runs[3], value, side="right")
                for k in range(a, b):
                    item = int(self.run_item[k])
                    for x, y in run_hits(first, last, step, int(self.runs[0][k]), int(self.runs[1][k]), int(self.runs[2][k])):
                        line = (item, y - x)
                        start, stop = covered.get(line, (0, 0))
                        if start <= x < stop:
                            continue
                        before, after = self.common_run(text, x, y, item)
                        covered[line] = x - before, x + after
                        if before + after >= self.span and before + after > best.get((int(r), item), 0):
                            best[int(r), item] = before + after
        return [(r, item, run) for (r, item), run in best.items()]


def periodic_runs(value: np.ndarray, place: np.ndarray, owner: np.ndarray, gram: int) -> tuple[np.ndarray, ...]:
    """(first, last, step, value) of places of one gram that follow each other at one step of at most ``gram``.

    Sorted by value, owner and place on input.  Such places lie in a stretch
    that repeats itself with that period; a place of its own is a run too.
    """
    if not len(place):
        return place, place, place, value
    gap = np.diff(place)
    joined = (np.diff(owner) == 0) & (value[1:] == value[:-1]) & (gap <= gram)
    same = joined.copy()
    same[1:] &= ~joined[:-1] | (gap[1:] == gap[:-1])
    first = np.flatnonzero(np.append(True, ~same))
    last = np.append(first[1:], len(place)) - 1
    step = np.where(last > first, np.append(gap, 0)[np.minimum(first, len(gap))], 0)
    return place[first], place[last], step, value[first]


def run_hits(a0: int, a1: int, step_a: int, b0: int, b1: int, step_b: int) -> list[tuple[int, int]]:
    """Places of two runs of one gram whose extensions hold the longest common run.

    Of two stretches with one period, a common run that goes beyond a stretch
    lies where their starts or their ends meet; a longest one inside starts
    at the first place of one and at the first or second of the other.  Runs
    of other steps are no two stretches of one period: all their places meet.
    """
    if step_a and step_b and step_a != step_b:
        return [(a, b) for a in range(a0, a1 + 1, step_a) for b in range(b0, b1 + 1, step_b)]
    hits = {(a0, b0), (a1, b1)}
    if step_b:
        hits.add((a0, b0 + step_b))
    if step_a:
        hits.add((a0 + step_a, b0))
    return sorted(hits)


def _bounded(items: DataFrame, limit_chars: int) -> bool:
    size = items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("n")).first()["n"]
    return size <= limit_chars


_FOUND = "doc_id bigint, item_id bigint, run int"


def leaked_items(
    documents: DataFrame,
    items: DataFrame,
    span: int = SPAN,
    gram: int = GRAM,
    broadcast_chars: int = 4_000_000,
) -> DataFrame:
    """doc_id, item_id, run: every document and item that share ``span`` letters or digits in a row.

    ``documents``: doc_id, text.  ``items``: item_id, text.  Other columns are
    ignored.  Null and short texts share nothing; repeated rows come out once
    per pair of ids, ``run`` being the longest.  Items of up to
    ``broadcast_chars`` characters together go to every task; more are joined
    by fingerprint through a shuffle, with the same result.
    """
    if not 0 < gram <= span:
        raise ValueError("gram must be between 1 and span")
    items = items.select("item_id", "text").where("text is not null and item_id is not null")
    documents = documents.select("doc_id", "text").where("text is not null")
    if not _bounded(items, broadcast_chars):
        return _leaked_by_shuffle(documents, items, span, gram)
    rows = sorted((r["item_id"], r["text"]) for r in items.collect())
    shared = documents.sparkSession.sparkContext.broadcast(rows)
    cache: dict[str, Items] = {}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "items" not in cache:
            cache["items"] = Items([r[0] for r in shared.value], [r[1] for r in shared.value], span, gram)
        known = cache["items"]
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in codepoints.slices(texts, 1 << 20):
                hits = known.leaks(*codepoints.letters_only(*codepoints.decode(texts[a:b])))
                if hits:
                    row, item, length = (np.array(x) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row + a)), pa.array(known.ids[item]), pa.array(length.astype(np.int32))],
                        names=["doc_id", "item_id", "run"],
                    )

    found = documents.mapInArrow(run, _FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def _marked(df: DataFrame, key: str, span: int, gram: int) -> DataFrame:
    """key, mark: the winnowed fingerprints of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in codepoints.slices(texts, 1 << 20):
                chars, offsets = codepoints.letters_only(*codepoints.decode(texts[a:b]))
                row, marks, _ = fingerprints(chars, offsets, span, gram)
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(row + a)), pa.array(marks.view(np.int64))], names=[key, "mark"]
                )

    return df.select(key, "text").mapInArrow(run, f"{key} bigint, mark bigint").distinct()


def _leaked_by_shuffle(documents: DataFrame, items: DataFrame, span: int, gram: int) -> DataFrame:
    marks = _marked(items, "item_id", span, gram)
    # Documents without any item's fingerprint leave here; the others meet each candidate item once.
    met = lookup_join(_marked(documents, "doc_id", span, gram), marks, ["mark"], ["doc_id"])
    candidates = cut_lineage(met.select("doc_id", "item_id").distinct())
    asked = lookup_join(candidates, items.withColumnRenamed("text", "item_text"), ["item_id"], ["doc_id"])
    pairs = lookup_join(asked, documents, ["doc_id"], ["item_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # The batch's items are prepared once, and each of its texts is probed once with all of them.
            items_of = list(dict.fromkeys(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)))
            texts_of = dict(zip(zip(batch.column(1).to_pylist(), batch.column(4).to_pylist(), strict=True), batch.column(3).to_pylist(), strict=True))
            known = Items([i for i, _ in items_of], [t for _, t in items_of], span, gram)
            ids = pa.array([k[0] for k in texts_of], pa.int64())
            texts = pa.array(list(texts_of.values()), pa.string())
            for a, b in codepoints.slices(texts, 1 << 20):
                hits = known.leaks(*codepoints.letters_only(*codepoints.decode(texts[a:b])))
                if hits:
                    row, item, length = (np.array(x) for x in zip(*hits, strict=True))
                    yield pa.RecordBatch.from_arrays(
                        [ids.take(pa.array(row + a)), pa.array(known.ids[item]), pa.array(length.astype(np.int32))],
                        names=["doc_id", "item_id", "run"],
                    )

    digest = F.xxhash64("text").alias("digest")  # rows may repeat an id with another text
    found = pairs.select("item_id", "doc_id", "item_text", "text", digest).mapInArrow(run, _FOUND)
    return found.groupBy("doc_id", "item_id").agg(F.max("run").alias("run"))


def leak_report(found: DataFrame) -> DataFrame:
    """item_id, n_documents, longest_run: what leaked, per evaluation item."""
    return found.groupBy("item_id").agg(
        F.count(F.lit(1)).alias("n_documents"), F.max("run").alias("longest_run")
    )
