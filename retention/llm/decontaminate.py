"""Benchmark decontamination: rare n-gram seeds find passages, Smith-Waterman alignment scores them.

1. Word counts of the benchmark's vocabulary over the whole corpus, in one pass, give every word its information
   -log2 p. Counts of a few thousand words leave each task, not counts of the corpus.
2. A seed starts at every word of an item: the shortest run of at least ``SEED_WORDS`` words that carries ``SEED_BITS``
   bits, so seeds of common words are longer and chance hits stay as rare as hits of rare words. With ``whole`` an item
   that has no seed, being short or common, is searched as a whole: its exact copies are found in tables of any size.
3. Every whole document is searched for seeds. Hits of one item on nearby diagonals make a passage, with room for
   insertions on both sides.
4. Smith-Waterman over words (match 1, mismatch and gap -0.5) aligns item and passage. The score is the best local
   alignment over the item's length; 1 is a whole copy. Passages of ``LEAST`` or more are reported.

The item side is a stated query set: it is read in blocks of about ``BLOCK_ITEMS`` items, each block is sent to the tasks and
searched against all documents. Nothing is shuffled but counts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filter_texts, pieces

SEED_WORDS, SEED_BITS = 3, 22.0
LEAST = 0.4
GAP = MISMATCH = 0.5
BLOCK_ITEMS = 20_000
_SPACES = bytes(c if chr(c).isalnum() or c >= 128 else 32 for c in range(256))
# letters of scripts without spaces (Thai, Lao, Tibetan, Burmese, Khmer, kana, Han) and the punctuation of the last two
_LETTER = re.compile("[\u0e00-\u0fff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3021-\u3029\u3040-\u30fa\u30fc-\u31ff\u3400-\u4dbf"
                     "\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff]")
_STOP = re.compile("[\u3000-\u303f\u30fb\uff01-\uff0f\uff1a-\uff20\uff3b-\uff40\uff5b-\uff65]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-case words; ASCII punctuation separates like white space. Letters of scripts without spaces are words each."""
    text = (text or "").lower()
    if not text.isascii() and _LETTER.search(text):
        text = _STOP.sub(" ", _LETTER.sub(r" \g<0> ", text))
    return text.encode("utf-8", "surrogatepass").translate(_SPACES).split()


class Items:
    """A block of benchmark items: vocabulary, word numbers (from 1) and, after weigh(), the seeds and whole items."""

    def __init__(self, rows: list[tuple]):
        self.ids = [r[0] for r in rows]
        self.vocab: dict[bytes, int] = {}
        self.words = [np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(r[1])], dtype=np.int64)
                      for r in rows]

    def weigh(self, count: np.ndarray, total: int, whole: bool = False) -> Items:
        """count: occurrences in the corpus by word number; total: all words; whole: search items without seeds whole."""
        bits = -np.log2((count + 1.0) / (total + len(count) + 1.0))
        found: dict[int, list[tuple]] = {}
        for item, ws in enumerate(self.words):
            for i in range(len(ws)):
                n, b = 0, 0.0
                while i + n < len(ws) and (n < SEED_WORDS or b < SEED_BITS):
                    b += bits[ws[i + n]]
                    n += 1
                if n >= SEED_WORDS and b >= SEED_BITS:
                    found.setdefault(n, []).append((int(_keys(ws[i:i + n], n)[0]), item, i))
        self.seeds = self._sorted(found)
        seeded = {r[1] for rows in found.values() for r in rows}
        short: dict[int, list[tuple]] = {}
        for item, ws in enumerate(self.words):
            if whole and len(ws) and item not in seeded:
                short.setdefault(len(ws), []).append((int(_keys(ws, len(ws))[0]), item, 0))
        self.whole = self._sorted(short)
        return self

    @staticmethod
    def _sorted(found: dict[int, list[tuple]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length: sorted keys, and (item, place) of each."""
        return {n: (np.array([r[0] for r in sorted(rows)], dtype=np.uint64), np.array([r[1:] for r in sorted(rows)]))
                for n, rows in found.items()}

    def numbers(self, texts: list) -> tuple[np.ndarray, np.ndarray, list]:
        """Word numbers of all texts in a line (0: not in the benchmark), a 0 after each; starts; the words."""
        get = self.vocab.get
        words = [words_of(t) for t in texts]
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        flat = np.zeros(int(size.sum()), dtype=np.int64)
        start = np.cumsum(size) - size
        for s, ws in zip(start, words):
            flat[s:s + len(ws)] = list(map(get, ws, repeat(0)))
        return flat, start, words

    def passages(self, texts: list) -> list[tuple]:
        """(text number, item number, score, first word, end word, passage) of every passage that scores enough."""
        flat, start, words = self.numbers(texts)
        hits = [np.zeros((0, 4), dtype=np.int64)]  # text, item, diagonal, place
        known = flat > 0
        for n, (keys, where) in self.seeds.items():
            place, seed = _hits(flat, known, n, keys)
            text = np.searchsorted(start, place, side="right") - 1
            item, i = where[seed].T
            hits.append(np.stack([text, item, place - i, place], axis=1))
        found = []
        for n, (keys, where) in self.whole.items():
            place, seed = _hits(flat, known, n, keys)
            text = np.searchsorted(start, place, side="right") - 1
            for t, q, a in zip(text.tolist(), where[seed, 0].tolist(), (place - start[text]).tolist()):
                found.append((t, q, 1.0, a, a + n, b" ".join(words[t][a:a + n]).decode("utf-8", "replace")))
        hits = np.concatenate(hits)
        hits = np.unique(hits[:, :3], axis=0)
        regions: list[list[int]] = []  # text, item, from, to, first diagonal
        for t, q, d in hits.tolist():
            room = len(self.words[q])
            last = regions[-1] if regions else None
            if last and (last[0], last[1]) == (t, q) and d - last[4] <= room // 2:
                last[3] = d + room + room // 3
            else:
                regions.append([t, q, d - room // 3, d + room + room // 3, d])
        end = np.r_[start[1:] - 1, len(flat) - 1]
        spans = [(t, q, max(a, start[t]), min(b, end[t])) for t, q, a, b, _ in regions]
        for i in range(0, len(spans), 512):
            part = spans[i:i + 512]
            items = [self.words[q] for _, q, _, _ in part]
            rows = [flat[a:b] for _, _, a, b in part]
            best, stop = smith_waterman(items, rows)
            good = [j for j in range(len(part)) if best[j] >= LEAST * len(items[j])]
            # the same alignment read backwards ends where it began
            _, back = smith_waterman([items[j][::-1] for j in good], [rows[j][:stop[j]][::-1] for j in good])
            for j, b in zip(good, back):
                t, q, a, _ = part[j]
                first, last = a + stop[j] - b - start[t], a + stop[j] - start[t]
                found.append((t, q, float(best[j] / len(items[j])), int(first), int(last),
                              b" ".join(words[t][first:last]).decode("utf-8", "replace")))
        kept = []  # of overlapping passages of a text and item the best
        for row in sorted(found, key=lambda r: (r[0], r[1], -r[2], r[3])):
            if not any(k[:2] == row[:2] and k[3] < row[4] and row[3] < k[4] for k in reversed(kept[-8:])):
                kept.append(row)
        return kept


def _hits(flat: np.ndarray, known: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in the line of word numbers where a run of n has one of the sorted keys, and that key's number."""
    if len(flat) < n:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    run = known[:len(flat) - n + 1].copy()
    for j in range(1, n):
        run &= known[j:len(flat) - n + 1 + j]
    at = np.flatnonzero(run)
    own = _keys(flat, n, at)
    lo, hi = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
    some = hi > lo
    at, lo, many = at[some], lo[some], (hi - lo)[some]
    return np.repeat(at, many), np.repeat(lo - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _keys(ids: np.ndarray, n: int, at: np.ndarray | None = None) -> np.ndarray:
    """A key for each run of n word numbers (at the given places)."""
    ids = ids.astype(np.uint64)
    at = np.arange(len(ids) - n + 1) if at is None else at
    h = np.full(len(at), n, dtype=np.uint64)
    for j in range(n):
        h = (h ^ ids[at + j]) * _MIX
        h ^= h >> np.uint64(29)
    return h


def smith_waterman(items: list[np.ndarray], rows: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Best local score of each pair, and the end of that alignment in the row; the pairs run side by side."""
    if not items:
        return np.zeros(0), np.zeros(0, dtype=np.int64)
    q = np.full((len(items), max(map(len, items))), -1)
    r = np.full((len(rows), max(1, max(map(len, rows)))), -2)
    for i, (a, b) in enumerate(zip(items, rows)):
        q[i, :len(a)], r[i, :len(b)] = a, b
    slope = GAP * np.arange(r.shape[1] + 1, dtype=np.float32)
    h = np.zeros((len(items), r.shape[1] + 1), dtype=np.float32)
    best, stop = np.zeros(len(items), dtype=np.float32), np.zeros(len(items), dtype=np.int64)
    for j in range(q.shape[1]):
        new = np.zeros_like(h)
        new[:, 1:] = h[:, :-1] + np.where(r == q[:, j, None], np.float32(1), np.float32(-MISMATCH))
        np.maximum(new, h - np.float32(GAP), out=new)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + slope, axis=1) - slope  # gaps along the row
        top = h.argmax(axis=1)
        value = h[np.arange(len(h)), top]
        better = value > best + 1e-4
        best[better], stop[better] = value[better], top[better]
    return best, stop


def item_blocks(benchmark: DataFrame, corpus: DataFrame, item_col: str, item_text: str, text_col: str,
                whole: bool = False) -> Iterator[Items]:
    """The benchmark in blocks, each with seeds weighed against the whole corpus."""
    rows = benchmark.select(F.col(item_col).alias("i"), F.col(item_text).alias("t")).where("t is not null")
    blocks = max(1, math.ceil(rows.count() / BLOCK_ITEMS))
    for k in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("t"), F.lit(blocks)) == k)
        items = Items([tuple(r) for r in part.orderBy("i", "t").collect()])  # about BLOCK_ITEMS rows
        yield items.weigh(*_word_counts(corpus, text_col, items), whole)


def _word_counts(corpus: DataFrame, text_col: str, items: Items) -> tuple[np.ndarray, int]:
    """Occurrences of the items' words in all documents, and the number of all words there."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(len(items.vocab) + 1, dtype=np.int64)
        for b in batches:
            for part in pieces(b):
                flat, start, _ = items.numbers(part.column(0).to_pylist())
                count += np.bincount(flat, minlength=len(count))
                count[0] -= len(start)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["word", "n"])

    found = corpus.select(F.col(text_col).alias("_text")).mapInArrow(run, "word bigint, n bigint")
    count = np.zeros(len(items.vocab) + 1, dtype=np.int64)
    for w, n in found.groupBy("word").agg(F.sum("n")).collect():  # at most the block's vocabulary
        count[w] = n
    total, count[0] = int(count.sum()), 0
    return count, total


def find_passages(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", whole: bool = False) -> DataFrame:
    """(id, item id, score, first_word, end_word, passage): every passage of a document that copies an item.

    Null or wordless texts and items match nothing. Items of less than ``SEED_WORDS`` words or ``SEED_BITS`` bits in all,
    which chance would find anywhere, match their exact copies with ``whole`` and else nothing. Repeated rows and items each return their rows. Word places count the lower-case
    words of words_of(); passage joins them by spaces.
    """
    kinds = dict(docs.select(id_col).dtypes)[id_col], dict(benchmark.select(item_col).dtypes)[item_col]
    src = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    out = None
    for items in item_blocks(benchmark, docs, item_col, item_text, text_col, whole):
        def run(batches: Iterator[pa.RecordBatch], items: Items = items) -> Iterator[pa.RecordBatch]:
            types = [pa.float64(), pa.int64(), pa.int64(), pa.string()]
            for b in batches:
                for part in pieces(b):
                    found = items.passages(part.column(1).to_pylist())
                    if found:
                        cols = list(zip(*found))
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(cols[0])), pa.array([items.ids[q] for q in cols[1]]),
                             *[pa.array(c, t) for c, t in zip(cols[2:], types)]],
                            names=["_id", "_item", "score", "first_word", "end_word", "passage"])

        block = src.mapInArrow(run, f"_id {kinds[0]}, _item {kinds[1]}, score double, first_word bigint, "
                                    "end_word bigint, passage string")
        out = block if out is None else out.union(block)
    return out.withColumnsRenamed({"_id": id_col, "_item": item_col})


def keep_uncontaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
                        item_text: str = "text", whole: bool = False) -> DataFrame:
    """The rows, whole, of which no passage copies an item; ``whole`` as in find_passages()."""
    for items in item_blocks(benchmark, docs, item_col, item_text, text_col, whole):
        def clean(texts: list, items: Items = items) -> np.ndarray:
            keep = np.ones(len(texts), dtype=bool)
            keep[[r[0] for r in items.passages(texts)]] = False
            return keep

        docs = filter_texts(docs, text_col, clean)
    return docs
