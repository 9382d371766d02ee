"""Segment trees and the audit against counting everything in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd

from retention.llm import divergence

SCHEMA = "doc_id bigint, text string, lang string, source string, n int, term string, total string, id string"


def naive(rows, least=10, most=10):
    table = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs, groups = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(table)))
        groups[lang or "", source or ""].update(found)
        docs[lang or ""].update(found.keys())
    out = []
    for (lang, source), count in groups.items():
        kept = sorted(t for t, d in docs[lang].items() if d >= least)

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p = shares(count)
        every = Counter()
        for (a, _), c in groups.items():
            if a == lang:
                every.update(c)
        q = shares(every)
        pairs = []
        for (a, b), c in groups.items():
            if a == lang and b != source:
                r = shares(c)
                pairs.append((sum((p[t] - r[t]) ** 2 // (p[t] + r[t]) for t in kept), b))
        terms = [((p[t] - q[t]) ** 2 // (p[t] + q[t]), t) for t in kept if count[t] and p[t] > q[t]]
        for part, items in (("pair", pairs), ("term", terms)):
            items.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (value, item) in enumerate(items)
                    if part == "pair" or i < most]
    return sorted(out)


def check(spark, rows, **how):
    df = spark.createDataFrame([(i, t, a, b, 1, "x", "y", "z") for i, (t, a, b) in enumerate(rows)], SCHEMA)
    got = sorted(tuple(r) for r in divergence.audit(df, **how).collect())
    assert got == naive(rows, how.get("least_docs", 10), how.get("most_terms", 10))
    return got


def test_walk_counts_every_pair_of_leaves_once():
    g = np.random.default_rng(2)
    for height in (0, 1, 5):
        leaves = g.integers(0, 3, (6, 1 << height))
        leaves[3] = leaves[1]
        leaves[4] = 0
        forest = divergence.Forest(leaves)
        first, second = np.triu_indices(6, 1)
        got = Counter()
        for p, a, b, often in zip(*forest.walk(first, second)):
            assert (p, a, b) not in got
            got[p, a, b] = often
        assert got == Counter((p, a, b) for p, (i, j) in enumerate(zip(first, second)) for a, b in zip(leaves[i], leaves[j]))
        assert forest.roots[1] == forest.roots[3]


def test_equal_subtrees_share_nodes():
    leaves = np.zeros((4, 1 << 10), dtype=np.int64)
    leaves[0, 5] = 7
    forest = divergence.Forest(leaves)
    assert all(len(left) <= 2 for left, _ in forest.levels)


def test_block_leaves_out_what_is_past_the_last_term():
    rows = pd.DataFrame({"source_no": [1, 2, 1, 2], "at": [-1, -1, 0, 2], "n": [3, 3, 5, 4]})
    got = pd.concat(divergence.walk_block(rows, 8))
    assert {tuple(r) for r in got.to_numpy().tolist()} == {
        (1, 0, 5, 5, 1), (1, 0, 0, 0, 1), (1, 0, 0, 4, 1), (2, 0, 0, 5, 1), (2, 0, 0, 0, 1), (2, 0, 4, 4, 1),
        (1, 2, 5, 0, 1), (1, 2, 0, 0, 1), (1, 2, 0, 4, 1)}


def test_terms_of_bytes():
    text = "Ab_c1d ÀÉz\x7fq\x00r [x] €uro İı"
    got = [t.decode() for some in divergence.terms(text.encode(), 4) for t in some]
    assert got == ["ab", "c", "d", "ÀÉz", "q", "r", "x", "€uro", "İı"]


def test_audit_of_random_documents(spark):
    g = random.Random(4)
    names = [f"w{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(120)] + ["Été", "été", "日本", "ÀB"]
    weights = [1 / (i + 1) for i in range(len(names))]
    rows = [(" ".join(g.choices(names, weights, k=g.randint(0, 60))).title(), g.choice(["en", "de"]),
             g.choice(["s0", "s0", "s0", "s1", "s2", "é"])) for _ in range(400)]
    got = check(spark, rows)
    assert {r[2] for r in got} == {"pair", "term"}
    check(spark, rows, least_docs=1, most_terms=3)


def test_odd_tables(spark):
    long = "Very long " * 60_000
    rows = [(None, None, None), (None, "en", None), ("", None, "a"), ("12 34", "en", "a"), (long, "en", "b"), ("alone", "xx", "only"),
            *[("same words here", "en", "a")] * 12, *[("same words there", "en", "c")] * 12, *[("tie tac", "fr", "x")] * 10,
            *[("tie tac", "fr", "y")] * 10]
    got = check(spark, rows)
    assert ("xx", "only") not in {r[:2] for r in got}  # no partner, no kept term
    assert [r for r in got if r[0] == "fr"] == [("fr", "x", "pair", "y", 0, 1), ("fr", "y", "pair", "x", 0, 1)]
    check(spark, rows, least_docs=1)
    assert check(spark, []) == []


def test_blocks_of_many_sources(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_PAIRS", 64)  # blocks of 8 ids
    monkeypatch.setattr(divergence, "FRONT", 32)
    g = random.Random(9)
    rows = [(" ".join(f"t{chr(97 + g.randrange(26))}{chr(97 + g.randrange(3))}" for _ in range(20)), "en", f"s{i % 9}") for i in range(150)]
    check(spark, rows, least_docs=3)
