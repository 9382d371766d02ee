import random

import numpy as np
import pytest
import xxhash

from retention.llm import minhash, simhash
from retention.llm.components import connected_components


def naive_fingerprint(text, words=4):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    parts = [w for w in lowered.split(" ") if w]
    if not parts:
        return 0
    shingles = [" ".join(parts[i:i + words]) for i in range(max(1, len(parts) - words + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    value = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    return value - (1 << 64) if value >> 63 else value


def naive_components(fps, bits=4):
    """{fingerprint: set of fingerprints it reaches}, by comparing all pairs."""
    fps, group = sorted(set(fps)), {}
    for f in fps:
        group.setdefault(f, {f})
    for a in fps:
        for b in fps:
            if ((a ^ b) & (2 ** 64 - 1)).bit_count() <= bits and group[a] is not group[b]:
                group[a] |= group[b]
                for x in group[a]:
                    group[x] = group[a]
    return group


def test_fingerprint_matches_naive(odd_rows):
    texts = [t for _, t in odd_rows] + ["One TWO Three\x0bfour five\xa0six", "ÀB c d e", "x " * 700 + "end of it all"]
    assert [simhash.fingerprint(t) for t in texts] == [naive_fingerprint(t) for t in texts]


@pytest.mark.parametrize("chunk", [3, 1024])
def test_links_keep_all_connections(spark, chunk):
    g = random.Random(3)
    fps = set()
    for _ in range(40):  # clusters of fingerprints a few bits apart, and chains between them
        f = g.getrandbits(64)
        for _ in range(g.choice([1, 2, 12, 45])):
            fps.add(f)
            for b in g.sample(range(64), g.randint(0, 5)):
                f ^= 1 << b
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp bigint")
    found = {r.node: r.label for r in connected_components(simhash.links(df, 4, 6, chunk)).collect()}
    truth = naive_components(fps)
    for f in fps:
        assert found.get(f, f) == min(truth[f])


def test_components_against_union_find(spark):
    g = random.Random(1)
    edges = [(g.randrange(300), g.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(60)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[max(find(a), find(b))] = min(find(a), find(b))
    got = {r.node: r.label for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    nodes = {x for e in edges for x in e if e[0] != e[1]}
    assert got == {x: find(x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_near_duplicates_of_odd_rows(make_docs, odd_rows):
    rows = simhash.near_duplicates(make_docs(odd_rows)).collect()
    assert len(rows) == len(odd_rows)
    truth = naive_components([naive_fingerprint(t) for _, t in odd_rows])
    ids = {}
    for i, t in odd_rows:
        ids.setdefault(naive_fingerprint(t), []).append(i)
    for r in rows:
        reach = [i for f in truth[r.fp] for i in ids[f] if i is not None]
        assert r.component == (min(reach) if reach else None)
    assert simhash.near_duplicates(make_docs([])).count() == 0


def test_keep_first_keeps_one_whole_row_of_each_group(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    rows = kept.collect()
    truth = naive_components([naive_fingerprint(t) for _, t in odd_rows])
    groups = {min(truth[naive_fingerprint(t)]): None for _, t in odd_rows}
    assert len(rows) == len(groups)
    assert {r.doc_id for r in rows} >= {1, 2, 5, 7} and 6 not in {r.doc_id for r in rows}
    assert all(r._k1 == "z" and r.fp == "y" for r in rows)
    assert simhash.keep_first(make_docs([])).count() == 0


def test_keep_first_tells_nulls_apart(spark):
    """(id 'a', no text) and (no id, text 'a') are two rows of two groups; a map column does no harm."""
    rows = [("a", None, {"k": 1}), (None, "a", {"k": 2}), (None, "a", {"k": 2}), ("b", "some other words here", None)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, extra map<string,int>")
    kept = simhash.keep_first(docs).collect()
    assert sorted((r.doc_id or "", r.text or "") for r in kept) == [("", "a"), ("a", ""), ("b", "some other words here")]


def test_minhash_estimates_likeness():
    g, errors = random.Random(5), []
    for share in np.linspace(0, 1, 30):
        a = [f"w{g.randrange(5000)}" for _ in range(400)]
        cut = int(share * 400)
        b = a[:cut] + [f"v{g.randrange(5000)}" for _ in range(400 - cut)]
        sets = [set(zip(*[x[j:] for j in range(5)])) for x in (a, b)]
        true = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
        errors.append(minhash.likeness(*[minhash.fingerprint(" ".join(x)) for x in (a, b)]) - true)
    assert abs(np.mean(errors)) < 0.02 and max(map(abs, errors)) < 0.15


def test_minhash_of_few_shingles():
    close = [minhash.likeness(minhash.fingerprint(f"only {i} words"), minhash.fingerprint(f"other {i} text")) for i in range(60)]
    assert np.mean(close) < 0.05
    assert minhash.fingerprint("") == minhash.fingerprint(None) == b""
    assert minhash.likeness(b"", b"") == 1 and minhash.likeness(b"", minhash.fingerprint("a")) == 0
    assert len(minhash.fingerprint("a")) == minhash.BINS * minhash.BITS // 8


def test_edited_pairs_against_naive(make_docs, odd_rows):
    rows = [(i, t) for i, t in odd_rows if i is not None] + [(100 + i, f"doc {i} " * (i + 3)) for i in range(50)]
    rows = sorted(set(rows), key=lambda r: -r[0])  # one row an id: the order of others is a hash's
    got = {r.doc_id: r for r in minhash.edited_pairs(make_docs(rows)).collect()}
    assert len(got) == len(rows)
    import hashlib
    for k, (i, t) in enumerate(rows):
        t, n = t or "", rows[(k + 1) % len(rows)][1] or ""
        new = t[:len(t) - len(t) // 2] + n[:len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert r.fingerprint == minhash.fingerprint(t).hex() and r.edited_fingerprint == minhash.fingerprint(new).hex()
        assert r.near_next == minhash.likeness(minhash.fingerprint(t), minhash.fingerprint(n))
    assert minhash.edited_pairs(make_docs(odd_rows)).count() == len(odd_rows)
    assert minhash.edited_pairs(make_docs([])).count() == 0
    lone = minhash.edited_pairs(make_docs([(1, "a b c d e f g h")])).collect()
    assert len(lone) == 1 and lone[0].near_next == 1
