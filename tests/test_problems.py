"""Hanging references, intervals and attributes at event time against brute force and in edge cases."""

from __future__ import annotations

import datetime as dt
import random

from tessera.operators import asof, hanging, intervals
from tessera.session import lookup_join

T = dt.datetime
REFS = "table_name string, field string, row_id bigint, ref_id string, recorded_at timestamp_ntz, kind string"
PARENTS = "kind string, key string, registered_at timestamp_ntz, deleted_at timestamp_ntz"


def found(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_hanging_reasons_and_dirt(spark):
    at = T(2024, 5, 1)
    rows = [("t", "f", i, ref, at, "entity") for i, ref in enumerate(["a", " A ", "b", "c", "nope", None, "  ", "", " a ", "x" * 100_000])]
    rows += [("t", "f", 20, "a", None, "entity"), ("t", "f", 21, "a", at, "source"), ("t", "f", 22, "nope", at, "entity")]
    refs = spark.createDataFrame(rows, REFS)
    parents = spark.createDataFrame(
        [("entity", "a", T(2024, 1, 1), None), ("entity", "b", T(2024, 1, 1), T(2030, 1, 1)), ("entity", "c", T(2024, 6, 1), None)], PARENTS
    )
    want = sorted([(2, "deleted"), (3, "late"), (4, "missing"), (9, "missing"), (21, "missing"), (22, "missing")])
    for size in (1, 2, 500_000):  # many ranges and many salts give the same rows as one
        assert found(hanging.hanging_references(refs, parents, size, size), "row_id", "reason") == want
    empty = spark.createDataFrame([], PARENTS)
    assert hanging.hanging_references(refs, empty).where("reason = 'missing'").count() == 10
    assert hanging.hanging_references(refs.limit(0), parents).count() == 0
    report = hanging.orphan_report(refs, hanging.hanging_references(refs, parents)).collect()
    assert {(r.month, r.n_refs, r.n_missing, r.n_deleted, r.n_late) for r in report} == {("2024-05", 9, 4, 1, 1), ("unknown", 1, 0, 0, 0)}


def test_entity_targets_follow_one_alias_step(spark):
    e = spark.createDataFrame(
        [("a", T(2020, 1, 1), None, "x"), ("a", T(2020, 1, 1), None, "x"), (None, None, None, "x"), ("b", None, T(2021, 1, 1), "x")],
        "id string, registered_at timestamp_ntz, deleted_at timestamp_ntz, key string",
    )
    a = spark.createDataFrame(
        [("old", "a"), ("older", "old"), ("a", "b"), (None, "a"), ("x", None), ("two", "b"), ("two", "a")], "alias_id string, canonical_id string"
    )
    assert found(hanging.entity_targets(e, a), "key", "entity_id") == [("a", "a"), ("b", "b"), ("old", "a"), ("two", "a")]


def test_periods_against_days(spark):
    rng = random.Random(3)
    rows, base = [], dt.date(2020, 1, 1)
    for i in range(400):
        a = base + dt.timedelta(rng.randrange(200))
        end = rng.choice([None, "", "9999-12-31", "2020-02-30", "soon"] + [str(a + dt.timedelta(rng.randrange(-3, 12)))] * 30)
        rows.append((f"e{i % 7}" if i % 3 else "hot", str(a) if rng.random() < 0.97 else "2020.1.1", end, i))
    df = spark.createDataFrame(rows, "e string, a string, b string, first int")
    for inclusive in (False, True):
        got = found(intervals.period_gaps(intervals.merged_periods(intervals.day_intervals(df, "e", "a", "b", inclusive))), "entity_id", "gap_from", "gap_to")
        want = []
        for e in {r[0] for r in rows}:
            spans = []
            for _, a, b, _ in (r for r in rows if r[0] == e):
                try:
                    first = dt.date.fromisoformat(a) if len(a) == 10 and a[4] == "-" else None
                    stop = dt.date(2021, 6, 1) if b in (None, "", "9999-12-31") else dt.date.fromisoformat(b) + dt.timedelta(inclusive)
                except ValueError:
                    continue
                if first and stop > first:
                    spans.append((first, stop))
            covered = {a + dt.timedelta(k) for a, b in spans for k in range((b - a).days)}
            day, hole = min(covered), None
            while day <= max(covered):
                if day not in covered:
                    hole = hole or day
                elif hole:
                    want.append((e, str(hole), str(day - dt.timedelta(1))))
                    hole = None
                day += dt.timedelta(1)
        assert got == sorted(want)


def test_periods_of_nothing(spark):
    df = spark.createDataFrame([(None, "2020-01-01", None), ("e", None, None), ("e", "2020-01-02", "2020-01-02")], "e string, a string, b string")
    assert intervals.merged_periods(intervals.day_intervals(df, "e", "a", "b", False)).count() == 0


def test_last_known_against_brute_force(spark):
    rng = random.Random(5)
    base = dt.date(2020, 1, 1)
    day = lambda n: str(base + dt.timedelta(n))
    versions = []
    for i in range(500):
        a = rng.randrange(300)
        end = rng.choice([None, "", "9999-12-31", day(a + rng.randrange(-2, 80)), day(a + rng.randrange(1, 80))])
        known = T(2020, 1, 1) + dt.timedelta(days=rng.randrange(350), seconds=rng.randrange(3))
        versions.append((rng.choice(["hot", "hot", "e1", "e2"]), day(a) if rng.random() < 0.95 else "unknown", end, known, i, rng.choice([None, "x", "y"]), rng.choice(["p", "q"])))
    df = spark.createDataFrame(versions, "entity_id string, valid_from string, valid_until string, indexed_at timestamp_ntz, chunk_row bigint, s string, t string")
    events = [(i, rng.choice(["hot", "e1", "e3", None]), rng.choice([None, *range(18262, 18650)])) for i in range(300)] + [(900, "hot", 18400)] * 2
    ev = spark.createDataFrame(events, "qa_row bigint, entity_id string, day int")
    got = found(asof.as_known(ev, asof.attribute_history(df, ["s", "t"]), ["s", "t"], "qa_row"), "qa_row", "s_row", "t")
    want = []
    for q, e, d in events:
        best = None
        for e2, a, b, known, row, _, t in versions:
            if e2 != e or d is None or a == "unknown":
                continue
            first = (dt.date.fromisoformat(a) - dt.date(1970, 1, 1)).days
            stop = 10**9 if b in (None, "", "9999-12-31") else (dt.date.fromisoformat(b) - dt.date(1970, 1, 1)).days
            if first <= d < stop and (known.date() - dt.date(1970, 1, 1)).days <= d:
                best = max(best or (), (first, known, row, t))
        if best:
            want.append((q, best[2], best[3]))
    assert got == sorted(want)
    assert asof.last_known(ev.limit(0), asof.attribute_history(df, ["s"])).count() == 0


def test_lookup_join_splits_hot_keys(spark):
    left = spark.range(1000).selectExpr("id", "if(id < 700, 'hot', concat('k', id)) as k")
    right = spark.createDataFrame([("hot", 1), ("k800", 2)], "k string, v int")
    for hot, small in ((10, 0), (10_000, 0), (10, 1 << 30)):
        assert lookup_join(left, right, ["k"], ["id"], "inner", hot, small).count() == 701
        assert lookup_join(left, right, ["k"], ["id"], "left", hot, small).count() == 1000
        assert lookup_join(left, right, ["k"], ["id"], "left_anti", hot, small).count() == 299
