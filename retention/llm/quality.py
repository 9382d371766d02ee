"""Quality score by compression: zstandard dictionaries of good and bad labelled text.

A text is cut into blocks of ``BLOCK`` bytes. Each block is compressed once with a dictionary built from good
texts and once with one built from bad texts, so a long text cannot hide behind its own history. The difference of
the two compressed sizes over the text's bytes is negative where the text reads like good text; their mean over the
bytes is small where the text repeats itself, which neither dictionary tells apart. A logistic curve over the two (and
their squares, and the difference weighted by the text's length) turns them into a calibrated probability. Lines that
both labels share say nothing about quality and stay out of the dictionaries.

Training rows are a bounded sample (``PER_LABEL`` rows of each label); the curve is moved from the sample's share of good
rows to the share among all labelled ones, so scores do not depend on the size of the table. Scoring reads every whole
text.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Platt, filter_texts, labelled_sample, map_texts

BLOCK = 1024
DICT_BYTES = 110_000
LEVEL = 3
PER_LABEL = 3000  # training rows of each label at most
MOST_BLOCKS = 1 << 15  # blocks that a dictionary is trained on at most: those of the lowest checksum


def _blocks(text: str | None) -> list[bytes]:
    """Pieces of BLOCK bytes; a text of white space alone has none, like an empty one."""
    raw = "" if text is None or text.isspace() else text
    raw = raw.encode("utf-8", "surrogatepass")
    return [raw[i:i + BLOCK] for i in range(0, len(raw), BLOCK)]


class CompressionClassifier:
    """fit() on good and bad texts; score() gives the probability of label 1 (good)."""

    def fit(self, good: list[str], bad: list[str], share: float | None = None) -> CompressionClassifier:
        """share: of good rows among all labelled ones, for the calibration (None: as in the sample)."""
        # one half of the texts builds the dictionaries, the other half calibrates
        lines = [{line for t in x for line in t.split("\n")} for x in (good, bad)]
        shared = lines[0] & lines[1]
        self.bytes = [self._dictionary(["\n".join(line for line in t.split("\n") if line not in shared)
                                        for t in x[0::2]]) for x in (good, bad)]
        self.prior = (len(good) + 1) / (len(good) + len(bad) + 2)
        cal = [*good[1::2], *bad[1::2]]
        y = np.array([1] * len(good[1::2]) + [0] * len(bad[1::2]))
        self.curve = Platt().fit(self.features(cal), y).towards(share, float(y.mean()) if len(y) else 0.0)
        return self

    @staticmethod
    def _dictionary(texts: list[str]) -> bytes:
        blocks = [b for t in texts for b in _blocks(t)]
        if len(blocks) > MOST_BLOCKS:
            blocks = sorted(blocks, key=zlib.crc32)[:MOST_BLOCKS]
        try:
            return zstandard.train_dictionary(DICT_BYTES, blocks, level=LEVEL).as_bytes()
        except (zstandard.ZstdError, ValueError):  # too little text to train on: the text itself is the dictionary
            return b"".join(blocks)[-DICT_BYTES:] or b"\n" * 8

    def _compressors(self) -> list:
        if "_made" not in self.__dict__:
            self._made = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(b), level=LEVEL,
                                                   write_content_size=False, write_dict_id=False)
                          for b in self.bytes]
        return self._made

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def features(self, texts: list) -> np.ndarray:
        good, bad = (c.compress for c in self._compressors())
        size = np.zeros((len(texts), 3))
        for i, t in enumerate(texts):
            for b in _blocks(t):
                size[i] += len(good(b)), len(bad(b)), len(b)
        n = size[:, 2] + 16
        d, m = (size[:, 0] - size[:, 1]) / n, (size[:, 0] + size[:, 1]) / 2 / n
        return np.c_[d, m, d * d, m * m, d * np.log(n), m * np.log(n), np.log(n)]

    def score(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        return self.curve(self.features(texts))


def fit(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "quality",
        per_label: int = PER_LABEL) -> CompressionClassifier:
    """Train on a bounded sample of the rows that ``marks`` (id, label) labels: at most ``per_label`` of each label."""
    found = labelled_sample(docs, marks, id_col, text, label, per_label, [1, 0])
    learnable = marks.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1))
    share = learnable.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return CompressionClassifier().fit(found[1], found[0], share)


def score(docs: DataFrame, model: CompressionClassifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score): probability of good quality of every whole text. Null, empty and blank texts have difference 0."""
    return map_texts(docs, id_col, text_col, "score double", lambda texts: [pa.array(model.score(texts))])


def keep_good(docs: DataFrame, model: CompressionClassifier, text_col: str = "text", least: float = 0.3) -> DataFrame:
    """The rows, whole, whose score is at least ``least``."""
    return filter_texts(docs, text_col, lambda texts: model.score(texts) >= least)
