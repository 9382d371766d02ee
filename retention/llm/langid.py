"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Character 1- to 3-grams of the lower-case text are hashed to ``ROWS`` features. Document frequencies are counted over
all rows that may be learnt from, in one distributed pass. The weights are trained by follow the regularised leader
(FTRL-proximal) with an elastic-net penalty, which leaves most of them exactly zero, on a bounded sample
(``PER_LANG`` texts of each language); a temperature fitted on texts kept out of training calibrates the scores.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import labelled_sample, map_texts, pieces

ROWS = 1 << 14
ORDERS = (1, 2, 3)
PER_LANG = 1500  # training rows of each language at most
PIECE = 24  # characters of the short pieces that calibrate beside whole texts
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.05, 3
UNKNOWN = "und"
_LETTER = re.compile(r"[^\W\d_]")


def counts(text: str) -> np.ndarray:
    """How often each feature occurs in the whole text."""
    code = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    h, rows = np.zeros(len(code), dtype=np.uint32), []
    for k in ORDERS:
        h = (h[:len(code) - k + 1] ^ code[k - 1:]) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        rows.append((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - ROWS.bit_length() + 1))
    return np.bincount(np.concatenate(rows), minlength=ROWS)


def document_frequencies(docs: DataFrame, text_col: str) -> tuple[int, np.ndarray]:
    """Number of non-null texts, and in how many of them each feature occurs; counted over all rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(ROWS, dtype=np.int64), 0
        for b in batches:
            for part in pieces(b):
                for t in part.column(0).to_pylist():
                    if t is not None:
                        df += counts(t) > 0
                        n += 1
        if n:
            some = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.r_[-1, some]), pa.array(np.r_[n, df[some]])],
                                             names=["row", "df"])

    found = docs.select(F.col(text_col).alias("_text")).mapInArrow(run, "row bigint, df bigint")
    total, df = 0, np.zeros(ROWS, dtype=np.int64)
    for row, n in found.groupBy("row").agg(F.sum("df")).collect():  # at most ROWS + 1 rows
        if row < 0:
            total = n
        else:
            df[row] = n
    return total, df


class LanguageModel:
    """fit() on texts by language; predict() gives language and probability."""

    def __init__(self, n: int, df: np.ndarray):
        self.idf = (np.log((1 + n) / (1 + df)) + 1).astype(np.float64)

    def vector(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        c = counts(text)
        at = np.flatnonzero(c)
        x = (1 + np.log(c[at])) * self.idf[at]
        return at, x / np.sqrt((x * x).sum())

    def fit(self, texts: dict[str, list[str]], seed: int = 5) -> LanguageModel:
        self.langs = sorted(texts)
        rows = [(self.vector(t), self.langs.index(x), i % 5 == 4) for x in self.langs for i, t in enumerate(texts[x])]
        train, cal = [r for r in rows if not r[2]], [r for r in rows if r[2]]
        k = len(self.langs)
        z, n = np.zeros((ROWS + 1, k)), np.zeros((ROWS + 1, k))  # the last row is the intercept
        order = np.random.default_rng(seed)
        for _ in range(EPOCHS):
            for i in order.permutation(len(train)):
                (at, x), y, _ = train[i]
                at, x = np.r_[at, ROWS], np.r_[x, 1.0]
                w = self._weights(z[at], n[at])
                p = self._softmax(x @ w)
                p[y] -= 1
                g = x[:, None] * p
                more = n[at] + g * g
                z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
                n[at] = more
        self.w = self._weights(z, n)
        self.temperature = 1.0
        if cal and k > 1:
            # a short piece from each text's middle: whole texts alone are never wrong, and any temperature would do
            short = [(self.vector(p), self.langs.index(x)) for x in self.langs for i, t in enumerate(texts[x]) if i % 5 == 4
                     for p in [t[len(t) // 2:len(t) // 2 + PIECE]] if _LETTER.search(p)]
            logits = np.array([self._logits(*v) for v in [r[0] for r in cal] + [r[0] for r in short]])
            y = np.array([r[1] for r in cal] + [r[1] for r in short])
            # one wrong label more than there are: without an error the best temperature would be zero
            miss = 1 / (len(y) + 1)
            losses = []
            for t in np.geomspace(0.01, 20, 120):
                p = np.log(self._softmax(logits / t) + 1e-12)
                losses.append((-((1 - miss) * p[np.arange(len(y)), y] + miss * p.mean(axis=1)).mean(), t))
            self.temperature = min(losses)[1]
        return self

    @staticmethod
    def _weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        """The elastic-net minimiser that follows the summed gradients z."""
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    @staticmethod
    def _softmax(v: np.ndarray) -> np.ndarray:
        e = np.exp(v - v.max(axis=-1, keepdims=True))
        return e / e.sum(axis=-1, keepdims=True)

    def _logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return x @ self.w[at] + self.w[ROWS]

    def predict(self, texts: list) -> tuple[list[str], list[float]]:
        lang, score = [], []
        for t in texts:
            if not t or not self.langs or not _LETTER.search(t):
                lang.append(UNKNOWN)
                score.append(0.0)
                continue
            p = self._softmax(self._logits(*self.vector(t)) / self.temperature)
            best = int(p.argmax())
            lang.append(self.langs[best])
            score.append(float(p[best]))
        return lang, score


def fit(rows: DataFrame, id_col: str = "doc_id", text: str = "text", lang: str = "lang",
        per_lang: int = PER_LANG) -> LanguageModel:
    """Document frequencies over all rows with text and language; weights from ``per_lang`` texts of each language."""
    rows = rows.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    model = LanguageModel(*document_frequencies(rows, text))
    return model.fit(labelled_sample(rows, None, id_col, text, lang, per_lang))


def predict(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row; ``und`` with score 0 if the text is null or has no letter."""
    def kernel(texts: list) -> list[pa.Array]:
        lang, score = model.predict(texts)
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    return map_texts(docs, id_col, text_col, "lang_pred string, score double", kernel)
