"""Targets by repeated sharing, takes and positions by plain loops."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wiretally.llm import mixing


def plain_targets(sizes: dict, weights=(5, 2, 1), ratio=1.5, repeats=2) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = ratio * sum(sizes.values()), set(names), {}
    while True:
        whole = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / whole > repeats * sizes[s] + 1e-9}
        if not above:
            return target | {s: left * weight[s] / whole for s in open_}
        for s in above:
            target[s] = repeats * sizes[s]
            left -= target[s]
            open_.remove(s)


def test_targets_equal_repeated_sharing(spark):
    chance = random.Random(6)
    for n in (1, 2, 5, 17):
        sizes = {f"s{k}": chance.randint(0, 3000) for k in range(n)} | {None: 40}
        table = spark.createDataFrame(list(sizes.items()), "source string, size long")
        found = {r.source: r.target for r in mixing.source_targets(table).collect()}
        assert found == pytest.approx(plain_targets(sizes))


def test_takes_come_near_targets_and_positions_follow_schedules(spark):
    chance = random.Random(7)
    rows = [(i, "w " * chance.randint(0, 60), f"s{min(i % 9, 3)}") for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mixing.mix_plan(docs).collect()
    source = {i: s for i, _, s in rows}
    taken, target, places = defaultdict(int), {}, defaultdict(list)
    for r in plan:
        taken[source[r.id]] += r.taken
        target[source[r.id]] = r.target
        assert r.taken <= 2 * r.size and len(r.positions) == r.copies and r.positions == sorted(r.positions)
        places[source[r.id]] += [(p, r.size) for p in r.positions]
    assert all(abs(taken[s] - target[s]) <= 60 for s in target)
    early = {s: sum(n for p, n in own if p < 0.5) / max(sum(n for _, n in own), 1) for s, own in places.items()}
    # The areas of the three lines below one half.
    assert early["s0"] == pytest.approx(0.5, abs=0.03) and early["s1"] == pytest.approx(0.375, abs=0.03)
    assert early["s2"] == pytest.approx(0.625, abs=0.03)
    assert all(0 <= p <= 1 for own in places.values() for p, _ in own)


def test_schedule_of_several_pieces_is_inverted(spark):
    knots = [0.0, 2.0, 2.0, 1.0]
    area = [1.0, 2.0, 1.5]
    points = [k / 50 * 900 for k in range(51)]
    table = spark.createDataFrame([(x,) for x in points], "done double")
    schedule = F.array(*map(F.lit, knots))
    found = [r[0] for r in table.select(mixing._progress(F.col("done"), F.lit(900.0), schedule)).collect()]
    for done, t in zip(points, found, strict=True):
        k, within = min(int(t * 3), 2), t * 3 - min(int(t * 3), 2)
        a, b = knots[k], knots[k + 1]
        reached = sum(area[:k]) + a * within + (b - a) * within**2 / 2
        assert math.isclose(reached / sum(area) * 900, done, abs_tol=1e-6)


def test_mixed_rows(spark):
    rows = [
        (1, "a b c d", "x", 5), (1, "a b c d", "x", 5), (2, None, "x", 5), (3, "", None, 5), (None, "q " * 50_000, None, 5),
        (4, "e f", "y", 5), (5, "g", "y", 5),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    docs = docs.withColumn("position", F.lit("old"))
    plan = mixing.mix_plan(docs)
    assert plan.count() == len(rows) and all(r.taken == r.copies * r.size for r in plan.collect())
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    order = [r.position for r in out.collect()]
    assert order == sorted(order) and len(order) == sum(r.copies for r in plan.collect())
    assert mixing.mix_plan(docs.limit(0)).count() == 0 and mixing.mixed(docs.limit(0)).count() == 0
    again = mixing.mix_plan(docs.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, plan.collect()))
