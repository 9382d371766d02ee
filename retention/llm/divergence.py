"""Source divergence audit: term counts of every two groups compared over hash-consed segment trees.

Each language keeps its common terms and numbers them; a group's counts, laid over the term ids, are the leaves of its segment
tree. Trees are built in blocks of ids, all groups of a language side by side: equal counts are one leaf, equal pairs of
children are one inner node (hash-consing). Two trees are walked together from their roots: at each level, node
pairs that are equal are merged and their number is remembered (the memo), so each is opened once. What a walk leaves is
how often each pair of counts occurs. These pairs are summed over all blocks and priced once each, in exact decimals.
Ids run from frequent to rare terms, so the long tail lies together and shares most of its nodes.

The walk of a group against its whole language prices the term part: only the best priced count pairs of a group are looked
up among its terms.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import pieces, stored

#: term ids are dealt to numbering buckets by frequency class and hash
BUCKETS = 64
#: count pairs that a block's walks leave, and node pairs in a walk's front, at most (about: one tree or pair is never cut)
BLOCK_PAIRS, FRONT = 1 << 22, 1 << 21
#: distinct (group, term) counts that a task holds before it hands them on
HELD = 200_000
ROOT_SOURCE = 0
SCALE = 1_000_000_000

_TERM_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: bytes, step: int = 1 << 22) -> Iterator[list[bytes]]:
    """Runs of letters A-Z, a-z and code points from 128 on, of UTF-8 bytes; only A-Z are lower-cased.

    A long text's runs come in several lists, so that few of them exist at a time.
    """
    plain, start = text.translate(_TERM_BYTES), 0
    while start < len(plain):
        end = plain.find(b" ", start + step)
        end = len(plain) if end < 0 else end
        yield plain[start:end].split()
        start = end


def _count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs): counts of a task's rows; the term null for the group itself (docs: its rows)."""
    held: dict[tuple, list[Counter]] = {}

    def flush() -> pa.RecordBatch:
        lang, source, term, n, docs = [], [], [], [], []
        for (a, b), (count, rows) in held.items():
            lang += [a] * len(rows)
            source += [b] * len(rows)
            term += [None if t is None else t.decode() for t in rows]
            n += [count[t] for t in rows]
            docs += rows.values()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.string()),
                                           pa.array(n, pa.int64()), pa.array(docs, pa.int64())],
                                          names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for part in pieces(b):
            for lang, source, text in zip(*(c.to_pylist() for c in part.columns)):
                count, rows = held.setdefault((lang, source), [Counter(), Counter()])
                found: Counter = Counter()
                for some in terms(text):
                    found.update(some)
                count.update(found)
                rows.update(found.keys())
                rows[None] += 1
            if sum(len(rows) for _, rows in held.values()) > HELD:
                yield flush()
    if held:
        yield flush()


def term_counts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, n, docs) of the whole table; a row with a null term for each group, docs: its rows."""
    def plain(c: str) -> Column:
        return F.coalesce(F.col(c), F.lit(""))

    src = docs.select(plain(lang).alias("lang"), plain(source).alias("source"), plain(text).cast("binary").alias("text"))
    found = src.mapInArrow(_count_terms, "lang string, source string, term string, n bigint, docs bigint")
    return found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def vocabulary(counts: DataFrame, least_docs: int) -> DataFrame:
    """(lang, term, lang_n, id): each language's terms in at least ``least_docs`` of its rows, numbered from 0.

    Frequent terms first: buckets of a frequency class and a hash, each numbered by itself behind the earlier ones.
    """
    kept = (counts.where("term is not null").groupBy("lang", "term")
            .agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs))
    # classes of a quarter octave: at most 4 x 63 x BUCKETS rows a language
    bucket = -F.floor(4 * F.log2("lang_n")) * BUCKETS + F.pmod(F.xxhash64("term"), F.lit(BUCKETS))
    kept = stored(kept.select("lang", "term", "lang_n", bucket.alias("bucket")), "vocabulary")
    sizes = kept.groupBy("lang", "bucket").agg(F.count("*").alias("k"))
    earlier = Window.partitionBy("lang").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offset = sizes.select("lang", "bucket", F.coalesce(F.sum("k").over(earlier), F.lit(0)).alias("before"))
    nth = F.row_number().over(Window.partitionBy("lang", "bucket").orderBy("lang_n", "term")) - 1
    return kept.withColumn("nth", nth).join(offset, ["lang", "bucket"]).select(
        "lang", "term", "lang_n", (F.col("nth") + F.col("before")).alias("id"))


class Forest:
    """Segment trees over the same leaves; ``leaves`` is trees x 2^h counts. Equal subtrees are one node.

    level[l] holds the children (left, right) of the nodes of height l + 1; ``values`` the counts of the leaf nodes.
    """

    def __init__(self, leaves: np.ndarray):
        self.values, ids = np.unique(leaves, return_inverse=True)
        ids = ids.reshape(leaves.shape)
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        while ids.shape[1] > 1:
            pairs, ids_flat = np.unique((ids[:, 0::2].astype(np.int64) << 32 | ids[:, 1::2]), return_inverse=True)
            self.levels.append((pairs >> 32, pairs & 0xFFFFFFFF))
            ids = ids_flat.reshape(len(ids), -1)
        self.roots = ids[:, 0]

    def walk(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """(pair, count, count, how often) of the leaves under the roots of the trees ``first[i]`` and ``second[i]``."""
        pair, a, b = np.arange(len(first)), self.roots[first].astype(np.int64), self.roots[second].astype(np.int64)
        often = np.ones(len(first), dtype=np.int64)
        for left, right in reversed(self.levels):
            a, b = np.concatenate([left[a], right[a]]), np.concatenate([left[b], right[b]])
            pair, often = np.concatenate([pair, pair]), np.concatenate([often, often])
            order = np.lexsort((b, a, pair))
            pair, a, b, often = pair[order], a[order], b[order], often[order]
            new = np.r_[True, (np.diff(pair) != 0) | (np.diff(a) != 0) | (np.diff(b) != 0)]
            pair, a, b, often = pair[new], a[new], b[new], np.add.reduceat(often, np.flatnonzero(new))
        return pair, self.values[a], self.values[b], often


def walk_block(rows: pd.DataFrame, width: int) -> Iterator[pd.DataFrame]:
    """(a, b, n_a, n_b, often) of one block: ``rows`` holds (source number, id within the block or -1, n).

    Every source of the language has a row with id -1, and its n is the number of ids in the block. Source 0 stands for the
    whole language and is compared with each other one, as the second.
    """
    used = int(rows.loc[rows["at"] < 0, "n"].iloc[0])
    sources = np.sort(rows["source_no"].unique())
    leaves = np.zeros((len(sources) + 1, width), dtype=np.int64)
    rows = rows[rows["at"] >= 0]
    leaves[np.searchsorted(sources, rows["source_no"]) + 1, rows["at"]] = rows["n"]
    leaves[0] = leaves.sum(axis=0)
    leaves[:, used:] = -1  # past the last term
    forest = Forest(leaves)
    names = np.r_[ROOT_SOURCE, sources]
    step = max(1, FRONT // width)
    for a in range(len(names)):
        others = np.arange(a + 1, len(names))
        for i in range(0, len(others), step):
            b = others[i:i + step]
            first, second = (b, np.zeros_like(b)) if a == 0 else (np.full_like(b, a), b)
            pair, n_a, n_b, often = forest.walk(first, second)
            real = n_a >= 0
            yield pd.DataFrame({"a": names[first[pair[real]]], "b": names[second[pair[real]]], "n_a": n_a[real], "n_b": n_b[real],
                                "often": often[real]})


def _share(n: str, total: str, kept: str) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * kept)) in exact decimals."""
    def whole(c: str) -> Column:
        return F.col(c).cast("decimal(18,0)")

    return (F.lit(1) + F.expr(f"(cast({n} as decimal(18,0)) + 2BD) * {SCALE}BD div (cast({total} as decimal(18,0)) + "
                              f"2BD * cast({kept} as decimal(18,0)))")).cast("bigint")


def _price(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)); shares are at most SCALE + 1, so squares fit a long."""
    return F.expr(f"({p} - {q}) * ({p} - {q}) div ({p} + {q})")


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = 10,
          most_terms: int = 10) -> DataFrame:
    """(lang, source, part, item, value, rank): how each source's use of terms differs within its language.

    Null texts, languages and sources are empty ones. A language's kept terms occur in at least ``least_docs`` of its rows;
    repeated rows count each. Part 'pair' compares a source with each other one of its language: the prices of all kept
    terms summed, 0 without kept terms. Part 'term' lists the ``most_terms`` kept terms that the source uses most above the
    language. Both are ranked by falling value, then by item. A language of one source has no pairs; an empty table
    returns no rows. Counts have up to 18 digits.
    """
    counts = stored(term_counts(docs, text, lang, source), "term-counts")
    words = stored(vocabulary(counts, least_docs), "vocabulary-ids")
    uses = stored(counts.where("term is not null").join(words, ["lang", "term"])
                  .select("lang", "source", "term", "id", "n", "lang_n"), "term-uses")
    number = F.row_number().over(Window.partitionBy("lang").orderBy("source"))  # as many rows as a group has partners
    total = uses.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    kept = words.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total"))
    groups = (counts.where("term is null").select("lang", "source", number.alias("source_no"))
              .join(total, ["lang", "source"], "left").join(kept, "lang", "left").na.fill(0, ["total", "kept", "lang_total"]))
    groups = stored(groups, "groups")
    most = groups.agg(F.max("source_no")).first()[0] or 1
    bits = max(3, min(13, (2 * BLOCK_PAIRS // (most + 1) ** 2).bit_length() - 1))

    block = F.shiftright("id", bits)
    leaves = uses.join(groups.select("lang", "source", "source_no"), ["lang", "source"]).select(
        "lang", block.alias("block"), "source_no", (F.col("id") - F.shiftleft(block, bits)).cast("int").alias("at"), "n")
    every = groups.where("kept > 0").select(
        "lang", "kept", "source_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.shiftright(F.col("kept") - 1, bits))).alias("block"))
    marks = every.select("lang", "block", "source_no", F.lit(-1).alias("at"),
                         F.least(F.lit(1 << bits).cast("bigint"), F.col("kept") - F.shiftleft("block", bits)).alias("n"))
    width = 1 << bits

    def walk(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.concat(list(walk_block(rows, width))).assign(lang=key[0])

    met = leaves.union(marks).groupBy("lang", "block").applyInPandas(
        walk, "a int, b int, n_a bigint, n_b bigint, often bigint, lang string")
    met = met.groupBy("lang", "a", "b", "n_a", "n_b").agg(F.sum("often").alias("often"))
    sizes = groups.select("lang", "source_no", "source", "total", "kept", "lang_total")
    met = met.join(sizes.withColumnRenamed("source_no", "a"), ["lang", "a"])
    other = sizes.select("lang", F.col("source_no").alias("b"), F.col("total").alias("total_b"))
    met = met.join(other, ["lang", "b"], "left").withColumn(
        "total_b", F.when(F.col("b") == ROOT_SOURCE, F.col("lang_total")).otherwise(F.col("total_b")))
    met = met.withColumns({"p": _share("n_a", "total", "kept"), "q": _share("n_b", "total_b", "kept")})
    priced = stored(met.select("lang", "a", "b", "source", "n_a", "n_b", "often", "p", "q", _price("p", "q").alias("value")),
                    "priced-pairs")
    return _pairs(priced, groups).union(_terms(priced, uses, most_terms))


def _pairs(priced: DataFrame, groups: DataFrame) -> DataFrame:
    summed = priced.where(F.col("b") != ROOT_SOURCE).groupBy("lang", "a", "b").agg(
        F.sum(F.col("value") * F.col("often")).alias("value"))
    sides = summed.union(summed.select("lang", "b", "a", "value"))
    this = groups.select("lang", F.col("source_no").alias("a"), "source")
    that = groups.select("lang", F.col("source_no").alias("b"), F.col("source").alias("item"))
    # every two sources of a language: these are the rows asked for
    both = this.join(that, "lang").where("a <> b").join(sides, ["lang", "a", "b"], "left")
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    return both.select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value")).select(
        "*", rank.alias("rank"))


def _terms(priced: DataFrame, uses: DataFrame, most: int) -> DataFrame:
    # a count pair occurs at least once, so the best ``most`` pairs (and their equals) hold the best terms
    best = priced.where((F.col("b") == ROOT_SOURCE) & (F.col("n_a") > 0) & (F.col("p") > F.col("q")))
    best = best.withColumn("place", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"))))
    best = best.where(F.col("place") <= most).select("lang", "source", F.col("n_a").alias("n"), F.col("n_b").alias("lang_n"), "value")
    found = uses.join(best, ["lang", "source", "n", "lang_n"])
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    return found.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value",
                        rank.alias("rank")).where(F.col("rank") <= most)
