"""Document fingerprints by one-permutation MinHash with optimal densification and packed b-bit values.

The word shingles of a text are hashed once. The top bits of a hash choose one of ``BINS`` bins, the smallest rest
stays in the bin. An empty bin takes the value of a bin that a second hash of (bin, attempt) picks, attempt by
attempt, until it hits one that was filled at first (optimal densification). Of every bin's value, hashed with the
bin's number, the low ``BITS`` bits are kept and packed. Two fingerprints agree in a bin by chance with probability 2^-BITS, so the likeness is
(share of equal bins - 2^-BITS) / (1 - 2^-BITS), not below 0.

``edited_pairs`` also needs each text's successor: rows are range-partitioned and sorted once, neighbours in a
partition meet as the partition streams by, and only the two rows at each border travel again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut_lineage, map_texts

BINS, BITS, WORDS = 256, 4, 5


def shingle_hashes(text: str, words: int = WORDS) -> np.ndarray:
    """64-bit hashes of all word shingles; a text of fewer words is one shingle; none without words."""
    parts = text.split()
    if not parts:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh3_64_intdigest
    h = np.fromiter(map(digest, parts), dtype=np.uint64, count=len(parts))
    k = min(words, len(h))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for j in range(k):  # mixes word hashes in order
        out = (out ^ h[j:len(h) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(32)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out ^ (out >> np.uint64(32))


@lru_cache
def _probes(bins: int, block: int, width: int = 64) -> np.ndarray:
    """The bins that each bin tries when empty: attempts ``block * width`` and on, a row of ``width`` for each bin."""
    x = np.arange(1, bins + 1, dtype=np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (
        np.arange(block * width, (block + 1) * width, dtype=np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
    x ^= x >> np.uint64(30)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return (x % np.uint64(bins)).astype(np.int64)


def fingerprint(text: str | None, words: int = WORDS, bins: int = BINS, bits: int = BITS) -> bytes:
    """The packed bins. A text without words has the empty fingerprint."""
    h = shingle_hashes(text or "", words)
    if not len(h):
        return b""
    h.sort()
    shift = np.uint64(64 - bins.bit_length() + 1)
    at = (h >> shift).astype(np.int64)
    first = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])  # sorted: the smallest of each bin
    value = np.zeros(bins, dtype=np.uint64)
    filled = np.zeros(bins, dtype=bool)
    value[at[first]], filled[at[first]] = h[first], True
    empty, block = np.flatnonzero(~filled), 0
    while len(empty):
        tried = _probes(bins, block)[empty]
        hits = filled[tried]
        first, hit = hits.argmax(axis=1), hits.any(axis=1)
        value[empty[hit]] = value[tried[np.arange(len(empty)), first][hit]]
        empty, block = empty[~hit], block + 1
    # a value that fills many bins is hashed with each bin's number, else its low bits agree by chance in all or none
    value = (value ^ np.arange(bins, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    low = ((value ^ (value >> np.uint64(32))) & np.uint64((1 << bits) - 1)).astype(np.uint8)
    return np.packbits((low[:, None] >> np.arange(bits - 1, -1, -1, dtype=np.uint8)) & 1).tobytes()


def likeness(a: bytes, b: bytes, bins: int = BINS, bits: int = BITS) -> float:
    """Estimated Jaccard likeness of the shingle sets; two empty fingerprints: 1; one empty: 0."""
    if not a or not b:
        return float(a == b)
    if a == b:
        return 1.0
    x = np.unpackbits(np.frombuffer(a, np.uint8) ^ np.frombuffer(b, np.uint8))
    same = 1 - x[:bins * bits].reshape(bins, bits).any(axis=1).mean()
    chance = 2.0 ** -bits
    return float(max(0.0, (same - chance) / (1 - chance)))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint string) of every row; null text counts as empty, empty text has the fingerprint ''."""
    return map_texts(docs, id_col, text_col, "fingerprint string",
                     lambda texts: [pa.array([fingerprint(t).hex() for t in texts], pa.string())])


def edited(text: str, following: str) -> str:
    """The last floor(n/2) code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


_OUT = pa.schema([("kind", pa.int32()), ("part", pa.int32()), ("id", pa.int64()), ("text", pa.string()),
                  ("n_chars", pa.int64()), ("sha", pa.binary()), ("fp", pa.binary()), ("efp", pa.binary()),
                  ("near_edited", pa.float64()), ("near_next", pa.float64())])
_DDL = ("kind int, part int, id bigint, text string, n_chars bigint, sha binary, fp binary, efp binary, "
        "near_edited double, near_next double")


def _compare(text: str, following: str, fp: bytes, next_fp: bytes) -> tuple:
    new = edited(text, following)
    efp = fingerprint(new)
    return (len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).digest(), fp, efp,
            likeness(fp, efp), likeness(fp, next_fp))


def edited_pairs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside those of its edited text and of the next row, in descending id.

    (id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next). Null text counts as
    empty. Rows of one id follow each other in the order of their text's hash and text, null ids come last, the last
    row is followed by the first (a lone row by itself). Texts are shuffled once; rows at borders of partitions, two
    of each, are finished by a second small step.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    src = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text"), F.col("text")]
    src = src.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    src = src.select(F.spark_partition_id().alias("part"), "id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for b in batches:
            part = b.column(0)[0].as_py() if b.num_rows else 0
            done = []
            for i, t in zip(b.column(1), b.column(2)):
                now = (i.as_py(), t.as_py())
                now = (*now, fingerprint(now[1]))
                if last is None:  # the partition's first row: the row before it is elsewhere
                    done.append((0, part, now[0], now[1], None, None, now[2], None, None, None))
                else:
                    done.append((2, part, last[0], None, *_compare(last[1], now[1], last[2], now[2])))
                last = now
                if len(done) == 1000:
                    yield _batch(done)
                    done = []
            if done:
                yield _batch(done)
        if last is not None:
            yield _batch([(1, part, last[0], last[1], None, None, last[2], None, None, None)])

    found = cut_lineage(src.mapInArrow(run, _DDL))
    # two rows of each partition: its first (kind 0) and its last (kind 1)
    ends = found.where("kind < 2")
    ring = Window.partitionBy(F.lit(0)).orderBy("part", "kind")
    marks = ends.select("part", "kind").withColumn("after", F.lead("part").over(ring))
    top = marks.agg(F.min("part")).first()[0]
    lasts = marks.where("kind = 1").select("part", F.coalesce("after", F.lit(top)).alias("after"))
    heads = ends.where("kind = 0").select(F.col("part").alias("after"), F.col("text").alias("follow"),
                                          F.col("fp").alias("next_fp"))
    border = (ends.where("kind = 1").join(lasts, "part").join(heads, "after")
              .select("id", "text", "follow", "fp", "next_fp"))

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(*[c.to_pylist() for c in b.columns])
            yield _batch([(2, 0, i, None, *_compare(t, f, p, q)) for i, t, f, p, q in rows])

    every = found.where("kind = 2").union(border.mapInArrow(finish, _DDL))
    text_of = {"sha": "edited_sha256", "fp": "fingerprint", "efp": "edited_fingerprint"}
    return every.select(F.col("id").cast(kind).alias(id_col), "n_chars",
                        *[F.lower(F.hex(c)).alias(name) for c, name in text_of.items()], "near_edited", "near_next")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _OUT)] if rows else
                                      [pa.array([], f.type) for f in _OUT], schema=_OUT)
