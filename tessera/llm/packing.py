"""Filling fixed-capacity containers with items (problem 7).

The histogram of item lengths has at most ``capacity`` entries.  Over it the
configuration linear program (which patterns of lengths, how often each) is
solved by multiplicative weights to a stated gap: every round prices patterns
by knapsack dynamic programming over the current weights, and lengths that are
covered too often lose weight.  The fractional counts are rounded, what is
left is packed by the longest fitting length, and the items take the
resulting places by their rank within their length.  Only the histogram and
the patterns are on the driver; the items never leave the executors.
"""

from __future__ import annotations

import base64
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage

#: Fixed value: tokens per container.
CAPACITY = 2048
#: The linear program is solved to this share above its lower bound, in so many pricings at most.
GAP, ROUNDS = 0.03, 5000
#: A length with more items than this is ranked in several tasks.
ROWS_PER_SALT = 100_000


def encoder(path: str):
    """Byte-level BPE of a rank file (base64 token and rank per line)."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def tokenizer_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_counts(documents: DataFrame, path: str | None = None, row: str = "doc_id", column: str = "text") -> DataFrame:
    """row, n_tokens of each whole text; null and empty texts have 0 tokens."""
    cache: dict[str, object] = {}
    kind = documents.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if "own" not in cache:
            cache["own"] = encoder(path or tokenizer_path())
        encode = cache["own"].encode_ordinary
        for batch in batches:
            counts = [len(encode(t)) if t else 0 for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64())], names=[row, "n_tokens"])

    return documents.select(row, column).mapInArrow(run, f"{row} {kind}, n_tokens bigint")


def value_table(value: np.ndarray, lengths: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: the largest value that lengths within each capacity up to ``capacity`` have."""
    best = np.zeros(capacity + 1)
    fit = np.searchsorted(lengths, np.arange(capacity + 1), side="right")
    for c in range(int(lengths[0]), capacity + 1):
        best[c] = max(best[c - 1], (value[: fit[c]] + best[c - lengths[: fit[c]]]).max())
    return best


def best_pattern(value: np.ndarray, best: np.ndarray, lengths: np.ndarray) -> dict[int, int]:
    """The multiset of lengths (index: copies) that a walk over the table picks by the present values."""
    pattern: Counter[int] = Counter()
    room = len(best) - 1
    while room >= lengths[0]:
        n = np.searchsorted(lengths, room, side="right")
        k = int((value[:n] + best[room - lengths[:n]]).argmax())
        pattern[k] += 1
        room -= int(lengths[k])
    return dict(pattern)


@dataclass
class Fractional:
    """A solution of the configuration linear program: patterns and their counts, its value and a lower bound.

    ``own`` are the containers of a single length that cover what the patterns leave uncovered.
    """

    patterns: list[tuple[dict[int, int], float]]
    own: list[tuple[dict[int, int], float]]
    value: float
    bound: float
    rounds: int

    @property
    def gap(self) -> float:
        return self.value / self.bound - 1 if self.bound else 0.0


def fractional_patterns(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS,
    slack: float = 0.01, rate: float = 0.3,
) -> Fractional:
    """Patterns and counts that cover all lengths' counts, within ``gap`` of the best, by multiplicative weights.

    The weight of a length is its dual price, at first its share of the
    capacity.  A round prices patterns by knapsack dynamic programming; its
    table is walked with the present weights as long as the pattern found is
    within ``slack`` of the table's value.  A pattern is used until it has
    covered its scarcest length once more, and the weight of each of its
    lengths falls by exp(-rate * the share of the need that this covers); all
    lengths take part, however often they are covered.  The counts, divided by
    a common coverage s, plus containers of their own for lengths covered less
    than s times, are a solution; the prices divided by the best pattern's
    value give a lower bound.  Both are compared every ten rounds, until they
    are within ``gap``; the rate is halved with each doubling of the coverage
    beyond ten.  ``rounds`` only bounds the time: what is left of the gap then
    is in the result.
    """
    need, alone = counts.astype(float), capacity // lengths
    weight = lengths / capacity
    covered, used, total, bound = np.zeros(len(lengths)), {}, 0.0, 0.0
    best_used = {((k, int(n)),): need[k] / n for k, n in enumerate(alone)}  # each length in containers of its own
    best_value, scale, short = float(sum(best_used.values())), 1.0, np.zeros(len(lengths))
    lowered = 10.0
    for done in range(rounds):
        table = value_table(weight, lengths, capacity)
        bound = max(bound, float(need @ weight) / table[capacity])
        if done % 10 == 0 and total:
            for s in np.unique(np.quantile(covered, (0, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5))):
                missing = np.maximum(0, 1 - covered / s) * need if s else need
                value = (total / s if s else 0.0) + float((missing / alone).sum())
                if value < best_value:
                    best_value, best_used, scale, short = value, dict(used), float(s), missing
            if best_value <= bound * (1 + gap):
                break
            if np.median(covered) > lowered:
                lowered, rate = lowered * 2, rate / 2
        fresh = True
        while True:
            pattern = best_pattern(weight, table, lengths)
            if not fresh and sum(weight[k] * n for k, n in pattern.items()) < (1 - slack) * table[capacity]:
                break
            fresh = False
            step = min(need[k] / n for k, n in pattern.items())
            for k, n in pattern.items():
                covered[k] += step * n / need[k]
                weight[k] *= np.exp(-rate * step * n / need[k])
            key = tuple(sorted(pattern.items()))
            used[key] = used.get(key, 0.0) + step
            total += step
    own = [({int(k): int(alone[k])}, float(short[k] / alone[k])) for k in np.flatnonzero(short)]
    return Fractional([(dict(k), float(x) / scale) for k, x in best_used.items()], own, float(best_value), float(bound), done + 1)


def _longest_first(
    lengths: np.ndarray, left: np.ndarray, capacity: int
) -> list[tuple[dict[int, int], int]]:
    """Patterns filled with the longest that still fits, each used while its items last; ``left`` becomes 0."""
    out = []
    while left.any():
        pattern = _filled(capacity, lengths, left)
        times = min(int(left[k]) // n for k, n in pattern.items())
        out.append((pattern, times))
        for k, n in pattern.items():
            left[k] -= n * times
    return out


def _filled(room: int, lengths: np.ndarray, left: np.ndarray) -> dict[int, int]:
    """What fills the room by the longest left lengths that fit: index and copies."""
    added: dict[int, int] = {}
    open_ = np.flatnonzero(left)
    while len(open_) and room >= lengths[open_[0]]:
        open_ = open_[: np.searchsorted(lengths[open_], room, side="right")]
        k = int(open_[-1])
        added[k] = min(int(left[k]), room // int(lengths[k]))
        room -= added[k] * int(lengths[k])
        open_ = open_[:-1]
    return added


@dataclass
class Packing:
    """Whole patterns: (length index: copies, times); the first ``from_program`` containers follow the linear program."""

    patterns: list[tuple[dict[int, int], int]]
    from_program: int
    program: Fractional

    @property
    def containers(self) -> int:
        return sum(t for _, t in self.patterns)


#: Parts of the fractional solution that the rounding tries, the whole first.
PARTS = (1.0, 0.95, 0.9, 0.8, 0.6, 0.4, 0.2)


def integral_patterns(
    lengths: np.ndarray, counts: np.ndarray, capacity: int, gap: float = GAP, rounds: int = ROUNDS
) -> Packing:
    """Patterns (length index: copies) and whole counts that hold every item exactly once.

    The linear program's patterns are rounded (see :func:`_rounded`), at first
    its whole solution and then smaller parts of it, until no more containers
    are needed than longest first alone needs; the first such part is taken.
    Only if every part needs more is longest first's packing
    taken, with no container from the program.
    """
    program = fractional_patterns(lengths, counts, capacity, gap, rounds)
    plain = _longest_first(lengths, counts.astype(np.int64).copy(), capacity)
    best = Packing(plain, 0, program)
    most = best.containers
    for part in PARTS:
        ours = _rounded(lengths, counts, capacity, program, part)
        if ours.containers <= most:
            return ours
    return best


def _rounded(lengths: np.ndarray, counts: np.ndarray, capacity: int, program: Fractional, part: float) -> Packing:
    """A part of the fractional solution in whole containers, and the rest longest first.

    Patterns, most used first, are taken as often as that part of their count
    rounded up allows and the items last.  Room that they leave takes what is
    left before new containers do.
    """
    left, out = counts.astype(np.int64).copy(), []
    for pattern, x in sorted(program.patterns, key=lambda p: -p[1]):
        times = min(math.ceil(x * part - 1e-9), *(int(left[k]) // n for k, n in pattern.items()))
        if times > 0:
            out.append((pattern, times))
            for k, n in pattern.items():
                left[k] -= n * times
    taken, fuller = sum(t for _, t in out), []
    for pattern, times in out:
        room = capacity - sum(int(lengths[k]) * n for k, n in pattern.items())
        while times and (added := _filled(room, lengths, left) if room else {}):
            n = min(times, *(int(left[k]) // c for k, c in added.items()))
            fuller.append((dict(Counter(pattern) + Counter(added)), n))
            for k, c in added.items():
                left[k] -= c * n
            times -= n
        if times:
            fuller.append((pattern, times))
    return Packing(fuller + _longest_first(lengths, left, capacity), taken, program)


def _pieces(items: DataFrame, row: str, size: str, capacity: int) -> DataFrame:
    """row, part, size: items within the capacity whole, larger ones as full containers and a rest."""
    items = items.select(row, F.col(size).cast("bigint").alias("size")).where("size > 0")
    whole = F.floor(F.col("size") / capacity).cast("int")
    parts = F.when(
        F.col("size") > capacity,
        F.concat(
            F.array_repeat(F.lit(capacity).cast("bigint"), whole),
            F.when(F.col("size") % capacity > 0, F.array(F.col("size") % capacity)).otherwise(F.array().cast("array<bigint>")),
        ),
    ).otherwise(F.array("size"))
    return items.select(row, F.posexplode(parts).alias("part", "size"))


def _histogram(pieces: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = sorted((r["size"], r["n"]) for r in pieces.groupBy("size").agg(F.count(F.lit(1)).alias("n")).collect())
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int64)


def pack(items: DataFrame, row: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """row, part, size, container: every item in a container of ``capacity``.

    An item within the capacity is whole.  A larger one is cut into full
    containers and a rest (parts 0, 1, ...).  Items of null or no size, blank
    texts among them, need no room and are left out; repeated rows are packed
    each.  ``items`` is read more than once: pass a materialised table.
    """
    pieces = _pieces(items, row, size, capacity)
    lengths, counts = _histogram(pieces)  # capacity rows at most
    if not len(lengths):
        return pieces.select(row, "part", "size", F.lit(0).cast("bigint").alias("container")).limit(0)
    # Ranks within a length: counted per salt first, so that a frequent length is no single task's sort.
    salts = -(-counts // ROWS_PER_SALT)
    spark = items.sparkSession
    known = spark.createDataFrame([(int(a), int(b)) for a, b in zip(lengths, salts, strict=True)], "size bigint, salts int")
    pieces = pieces.join(F.broadcast(known), "size")  # capacity rows at most
    pieces = pieces.select(row, "part", "size", F.pmod(F.xxhash64(row, "part"), F.col("salts")).cast("int").alias("salt"))
    if salts.max() > 1:
        per_salt = pieces.groupBy("size", "salt").agg(F.count(F.lit(1)).alias("n"))
        table = sorted((r["size"], r["salt"], r["n"]) for r in per_salt.collect())  # capacity + items / ROWS_PER_SALT rows
    else:
        table = [(int(a), 0, int(n)) for a, n in zip(lengths, counts, strict=True)]
    sizes = np.array([t[0] for t in table])
    at = np.searchsorted(sizes, lengths)
    n = np.array([t[2] for t in table], dtype=np.int64)
    before = np.cumsum(n) - n
    before -= np.repeat(before[at], np.diff(np.append(at, len(n))))
    # Places of each length, in the order of the patterns: (length, first rank, copies, first container).
    first_container, places = 0, []
    for pattern, times in integral_patterns(lengths, counts, capacity).patterns:
        places += [(int(lengths[k]), copies * times, copies, first_container) for k, copies in pattern.items()]
        first_container += times
    places.sort(key=lambda p: (p[0], p[3]))
    span = np.array([p[1] for p in places], dtype=np.int64)
    length_of = np.array([p[0] for p in places])
    first_rank = np.cumsum(span) - span
    head = np.searchsorted(length_of, length_of)
    first_rank -= first_rank[head]
    widest = int(salts.max())
    slot = sizes * widest + np.array([t[1] for t in table])
    packed = (
        slot, before, length_of, first_rank, np.array([p[2] for p in places]),
        np.array([p[3] for p in places], dtype=np.int64),
    )
    inner = Window.partitionBy("size", "salt").orderBy(row, "part")
    ranked = pieces.withColumn("inner", (F.row_number().over(inner) - 1).cast("bigint"))
    ranked = ranked.select(row, "part", "size", (F.col("size") * widest + F.col("salt")).alias("slot"), "inner")
    shared = spark.sparkContext.broadcast(packed)  # one entry per length and salt, and per pattern and length
    kind = items.schema[row].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, before, of, rank0, copies, container0 = shared.value
        top = np.int64(1) << 44  # more than any rank
        key = of.astype(np.int64) * top + rank0
        for batch in batches:
            size = batch.column(2).to_numpy()
            rank = before[np.searchsorted(slot, batch.column(3).to_numpy())] + batch.column(4).to_numpy()
            k = np.searchsorted(key, size * top + rank, side="right") - 1
            container = container0[k] + (rank - rank0[k]) // copies[k]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(container)], names=[row, "part", "size", "container"]
            )

    return ranked.mapInArrow(run, f"{row} {kind}, part int, size bigint, container bigint")


def program_report(items: DataFrame, row: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """lower_bound, program_value, gap, n_containers, from_program, share: how good the packing is; one row.

    lower_bound and program_value enclose the best fractional packing;
    from_program counts the containers that follow a pattern of the linear
    program.  Without items all are 0.
    """
    lengths, counts = _histogram(_pieces(items, row, size, capacity))
    row_ = (0.0, 0.0, 0.0, 0, 0, 0.0)
    if len(lengths):
        p = integral_patterns(lengths, counts, capacity)
        row_ = (p.program.bound, p.program.value, p.program.gap, p.containers, p.from_program, p.from_program / p.containers)
    return items.sparkSession.createDataFrame(
        [row_], "lower_bound double, program_value double, gap double, n_containers bigint, from_program bigint, share double"
    )


def pack_documents(documents: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Documents by their token counts in containers; each text is tokenised once."""
    return pack(token_items(documents, path), capacity=capacity)


def token_items(documents: DataFrame, path: str | None = None) -> DataFrame:
    """Token counts, materialised: each text is tokenised once for all uses."""
    return cut_lineage(token_counts(documents, path))


def fill_report(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """n_containers, n_items, used: how full the containers are."""
    by = packed.groupBy("container").agg(F.sum("size").alias("filled"), F.count(F.lit(1)).alias("n"))
    return by.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.sum("n").alias("n_items"),
        F.max("filled").alias("fullest"),
        F.round(F.sum("filled") / (F.count(F.lit(1)) * capacity), 6).alias("used"),
    )
