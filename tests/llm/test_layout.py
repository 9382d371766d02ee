"""Sharding and packing."""

import random
import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from retention.llm import kdshard, packing

def dims():
    return {"size": F.log2(F.octet_length("text") + 1), "lang": F.crc32("lang"), "source": F.crc32("source")}



def check_shards(docs, rows, shards):
    got = kdshard.shard(docs, dims(), shards).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    slots = defaultdict(list)
    shard_of = defaultdict(set)
    crc = Counter((i, zlib.crc32((t or "").encode()), len((t or "").encode()) + 8) for i, t in rows)
    assert crc == Counter((r.doc_id, r.text_crc32, r.size) for r in got)
    for r in got:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
        shard_of[r.text_crc32, r.size].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shard_of.values()) and set(sizes) <= set(range(shards))
    return sizes


def test_shards_are_near_equal(make_docs):
    g = random.Random(1)
    rows = [(i, "x" * g.randint(0, 400) + str(i)) for i in range(3000)] + [(5000 + i, "same text") for i in range(900)]
    sizes = check_shards(make_docs(rows), rows, 24)
    mean = sum(sizes.values()) / 24
    assert len(sizes) == 24 and max(sizes.values()) < 1.04 * mean and min(sizes.values()) > 0.96 * mean


def test_heavy_group_fills_a_shard_alone(make_docs):
    rows = [(i, "h" * 500) for i in range(300)] + [(1000 + i, f"light {i}") for i in range(2000)]
    sizes = check_shards(make_docs(rows), rows, 8)
    heavy = max(sizes.values())
    rest = sorted(sizes.values())[:-1]
    assert heavy == 300 * 508 and len(rest) == 7 and max(rest) < 1.02 * min(rest) + 60


def test_odd_tables(make_docs, odd_rows):
    check_shards(make_docs(odd_rows), odd_rows, 24)
    assert kdshard.shard(make_docs([]), dims(), 24).count() == 0
    check_shards(make_docs([(1, "a")]), [(1, "a")], 24)
    check_shards(make_docs([(None, None)] * 40), [(None, None)] * 40, 3)


def check_packing(docs, lengths, capacities=packing.CAPACITIES):
    got = packing.pack(docs, length=F.length("text"), capacities=capacities).collect()
    assert sum(r.length for r in got) == sum(lengths)
    bins, covered = defaultdict(list), defaultdict(list)
    for r in got:
        bins[r.bin].append(r)
        covered[r.doc_id].append((r.start, r.length))
    for rows in bins.values():
        at = 0
        for r in sorted(rows, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == r.bin_used and r.bin_capacity == min(c for c in capacities if c >= at)
    assert sorted(bins) == list(range(len(bins)))
    return bins, covered


def test_packing_places_every_piece_once(make_docs):
    g = random.Random(2)
    rows = [(i, "x" * g.choice([3, 10, 10, 10, 45, g.randint(1, 130), 500])) for i in range(1500)]
    bins, covered = check_packing(make_docs(rows), [len(t) for _, t in rows], (16, 64, 100))
    for i, t in rows:
        spans = sorted(covered[i])
        assert spans[0][0] == 0 and sum(n for _, n in spans) == len(t)
        assert all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:])) and max(n for _, n in spans) <= 100
    used = sum(r[0].bin_used for r in bins.values())
    assert used / sum(r[0].bin_capacity for r in bins.values()) > 0.97


def naive_waste(lengths, capacities):
    """Plain first-fit decreasing with the largest size, downsized."""
    bins = []
    for n in sorted(lengths, reverse=True):
        fit = [b for b in bins if sum(b) + n <= max(capacities)]
        (min(fit, key=lambda b: max(capacities) - sum(b)) if fit else bins.append([]) or bins[-1]).append(n)
    return sum(min(c for c in capacities if c >= sum(b)) - sum(b) for b in bins)


def test_plan_is_no_worse_than_one_size():
    g = random.Random(3)
    for _ in range(20):
        lengths = [g.randint(1, 100) for _ in range(g.randint(1, 300))]
        made = packing.plan(Counter(lengths), (25, 50, 100), 0)
        waste = sum((b.capacity - b.used) * b.count for b in made.bins)
        assert sum(b.used * b.count for b in made.bins) == sum(lengths)
        assert waste <= naive_waste(lengths, (25, 50, 100)) + 0.03 * sum(lengths)


def test_packing_odd_tables(make_docs, odd_rows):
    check_packing(make_docs(odd_rows), [len(t or "") for _, t in odd_rows])
    assert packing.pack(make_docs([])).count() == 0
    assert packing.pack(make_docs([(1, None)])).count() == 1  # the end mark


def test_a_common_length_is_spread(make_docs):
    plan = packing.pack(make_docs([(i, "same") for i in range(50)]))._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"Window .*\n.*Sort .*\n.*Exchange hashpartitioning\(length#\d+L, bucket#", plan)
