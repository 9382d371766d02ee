"""The cube method: totals, chances and targets against plain arithmetic."""

from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from retention.llm import mixing

SCHEMA = "doc_id bigint, source string, text string, size int, place string, target int, h int"


def naive_targets(words, weights=(3, 1, 2), budget=Fraction(3, 2), most=2):
    """Stop each target at most times its source and share the excess by weight, until none is above."""
    names = sorted(words, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    out, left, full = {}, budget * sum(words.values()), set()
    while True:
        free = [s for s in names if s not in full]
        total = sum(weight[s] for s in free)
        out |= {s: left * weight[s] / total for s in free}
        above = [s for s in free if out[s] >= most * words[s]]
        if not above:
            return out
        for s in above:
            out[s] = Fraction(most * words[s])
            left -= out[s]
            full.add(s)
        if len(full) == len(names):
            return out


def frame(spark, rows):
    return spark.createDataFrame([(i, s, t, 7, "x", 1, 2) for i, s, t in rows], SCHEMA)


def check(spark, rows, near=1.0):
    got = mixing.mix(frame(spark, rows)).collect()
    size = defaultdict(int)
    for _, s, t in rows:
        size[s] += len((t or "").split())
    want = naive_targets(size) if rows else {}
    of = defaultdict(list)
    for i, s, t in rows:
        of[i, len((t or "").split())].append(s)
    assert len(got) == len(rows)
    for r in got:
        assert (r.doc_id, r.size) in of and r.taken in (0, r.size, 2 * r.size)
        assert any(r.source_size == size[s] and r.target == pytest.approx(float(want[s]), abs=1e-6)
                   for s in of[r.doc_id, r.size])
    taken = defaultdict(int)
    for r in got:
        taken[r.source_size, round(r.target, 3)] += r.taken
    for s, words in size.items():
        if sum(1 for x in size if size[x] == words) == 1:
            assert abs(taken[words, round(float(want[s]), 3)] - float(want[s])) <= near
    return sorted((r.doc_id if r.doc_id is not None else -1, r.size, r.taken) for r in got)


def test_flight_keeps_totals_and_settles():
    g = np.random.default_rng(0)
    size = -np.sort(-np.r_[g.geometric(0.005, 300), [40_000, 9_000]]).astype(np.int64)
    chance = np.full(len(size), 0.37)
    moved = mixing.flight(size, chance, 12, np.random.default_rng(1))
    assert ((moved > 0) & (moved < 1)).sum() <= 12 and ((moved >= 0) & (moved <= 1)).all()
    assert moved.sum() == pytest.approx(chance.sum(), abs=1e-6) and size @ moved == pytest.approx(size @ chance, abs=1e-3)


def test_flight_keeps_every_chance_on_average():
    size = np.array([50, 20, 9, 9, 5, 3, 2, 1], dtype=np.int64)
    chance = np.array([0.2, 0.7, 0.5, 0.1, 0.9, 0.3, 0.6, 0.4])
    mean = np.mean([mixing.flight(size, chance, 2, np.random.default_rng(k)) for k in range(4000)], axis=0)
    assert np.abs(mean - chance).max() < 0.035


def test_equal_sizes_and_settled_chances():
    moved = mixing.settle(np.full(500, 10), np.full(500, 0.25), True, 5)
    assert set(moved) == {0.0, 1.0} and moved.sum() == 125
    assert mixing.settle(np.array([3, 4]), np.array([0.0, 1.0]), True, 5).tolist() == [0.0, 1.0]
    assert len(mixing.settle(np.array([], dtype=np.int64), np.array([]), True, 5)) == 0


def test_landing_is_the_nearest_corner():
    g = np.random.default_rng(3)
    for _ in range(20):
        size, chance = g.integers(1, 50, 8), g.random(8)
        got = mixing.landing(size, chance, 0.0)
        best = min(abs(sum(s for k, s in enumerate(size) if c >> k & 1) - size @ chance) for c in range(256))
        assert abs(size @ got - size @ chance) == pytest.approx(best)


def test_targets_stop_and_share_the_excess(spark):
    g = np.random.default_rng(5)
    for words in ({"a": 10, "b": 500, "c": 3, None: 70}, {"a": 0, "b": 0}, {"x": 5}, {chr(97 + i): int(g.integers(1, 10 ** 6)) for i in range(20)},
                  {"a": 1, "b": 1, "c": 10 ** 15}):
        rows = spark.createDataFrame([(s, n) for s, n in words.items()], "source string, size bigint")
        got = {r.source: r.target for r in mixing.targets(rows).collect()}
        assert got == {s: pytest.approx(float(t), rel=1e-12) for s, t in naive_targets(words).items()}


def test_sources_are_numbered_by_code_point(spark):
    names = ["b", "a", "Z", "é", "", None, "日", "\U0001F600", "～", *[f"k{i}" for i in range(200)]]
    rows = spark.createDataFrame([(s, 1) for s in names], "source string, size bigint")
    got = {r.source: r.place for r in mixing.targets(rows.repartition(7)).collect()}
    assert got == {s: i for i, s in enumerate(sorted(names, key=lambda s: (s is None, (s or "").encode())))}


def test_hot_source_of_many_blocks(spark):
    g = np.random.default_rng(6)
    rows = [(i, "hot" if i % 3 else f"s{i % 5}", "w " * int(g.geometric(0.05))) for i in range(9000)]
    first = check(spark, rows)
    again = mixing.mix(frame(spark, rows[::-1]).repartition(11)).collect()
    assert first == sorted((r.doc_id, r.size, r.taken) for r in again)


def test_odd_tables(spark):
    check(spark, [])
    check(spark, [(1, None, None), (2, "a", ""), (None, "a", " \t\n\x0b\x0c\r")])
    rows = [(1, "a", "one two"), (1, "a", "one two"), (None, None, "three words here"), (None, None, None), (2, "b", "long " * 60_000),
            (3, "b", "x"), (4, "", "a\xa0b c\x85d"), (5, "", "tie tie"), (6, "c", "")]
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(r.taken <= 2 * r.size for r in got)
    assert [r.size for r in got if r.doc_id == 4] == [2]
    # one row five thousand times
    check(spark, [(7, "a", "five words in each text")] * 5000 + [(i, "b", "w " * (i % 50)) for i in range(5000)], near=3)


def test_documents_of_sf001(spark):
    from retention.llm.queries import op13_mixing

    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    per = (op13_mixing(spark, sf).join(docs, "doc_id").groupBy("source")
           .agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.min("target").alias("low"), F.sum("size").alias("words")).collect())
    want = naive_targets({r.source: r.words for r in per})
    for r in per:
        assert r.low == r.target == pytest.approx(float(want[r.source]))
        assert abs(r.taken - r.target) <= 0.01 * r.target
