"""Token counts by offset-mapped attribution.

A document is encoded once, whole. Tokens of a byte-level vocabulary tile the text's bytes, so their spans follow
from their lengths and turn into character spans. The spans are joined with the sections' spans by their ends (both are
sorted), and a token that crosses a border goes where an explicit rule says:

- ``majority``: the section that holds most of its characters, the earlier one of equals;
- ``start``: the section that holds its first character inside any section.

A token in no section counts for section -1.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import pieces

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
RULES = ("majority", "start")


class Tokenizer:
    """A byte-level vocabulary. The driver reads the file; tasks get its ranks and build the encoder once."""

    def __init__(self, path: str = VOCABULARY, pattern: str = PATTERN):
        with open(path, "rb") as f:
            self.lines, self.pattern = f.read(), pattern

    def __getstate__(self) -> dict:
        return {"lines": self.lines, "pattern": self.pattern}

    def ready(self) -> tiktoken.Encoding:
        if "encoding" not in self.__dict__:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.lines.splitlines())}
            self.size = np.zeros(max(ranks.values()) + 1, dtype=np.int64)
            for token, n in ranks.items():
                self.size[n] = len(token)
            self.encoding = tiktoken.Encoding("given", pat_str=self.pattern, mergeable_ranks=ranks, special_tokens={})
        return self.encoding

    def spans(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, first and end character of every token; a token of part of a character spans all of it."""
        ids = np.array(self.ready().encode_ordinary(text), dtype=np.int64)
        end = np.cumsum(self.size[ids])
        begin = end - self.size[ids]
        raw = np.frombuffer(text.encode("utf-8"), dtype=np.uint8)
        if len(raw) == len(text):
            return ids, begin, end
        chars = np.r_[0, np.cumsum((raw & 0xC0) != 0x80)]
        return ids, chars[begin + 1] - 1, chars[end]


def lines(text: str) -> np.ndarray:
    """The sections of a text: its lines, each with its newline, as (first, end) character rows."""
    parts = text.split("\n")
    size = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1
    end = np.cumsum(size)
    end[-1] -= 1
    first = np.r_[0, end[:-1]]
    return np.stack([first, end], axis=1)[first < end] if text else np.zeros((0, 2), dtype=np.int64)


def attribute(first: np.ndarray, end: np.ndarray, sections: np.ndarray, rule: str = "majority") -> np.ndarray:
    """For each token span the number of its section (sorted, without overlap), -1 for none."""
    if not len(sections):
        return np.full(len(first), -1)
    lo = np.searchsorted(sections[:, 1], first, side="right")  # sections that end after the token begins ...
    hi = np.searchsorted(sections[:, 0], end, side="left")  # ... and begin before it ends
    out = np.where(lo < hi, lo, -1)
    if rule == "majority":
        for i in np.flatnonzero(hi - lo > 1):
            held = np.minimum(sections[lo[i]:hi[i], 1], end[i]) - np.maximum(sections[lo[i]:hi[i], 0], first[i])
            out[i] = lo[i] + int(held.argmax())
    return out


def count_tokens(docs: DataFrame, tokenizer: Tokenizer, sections: Callable[[str], np.ndarray] = lines,
                 rule: str = "majority", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, section, first_char, end_char, n_tokens, n_crossing): one row for every section of every document.

    n_crossing: how many of the tokens cross a border. ``sections`` gives sorted spans without overlap. Tokens
    outside all of them make a row of section -1 with null spans. Null and empty texts have no section and no row.
    Repeated rows and null ids each return their rows.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    kind = dict(docs.select(id_col).dtypes)[id_col]
    names = ["section", "first_char", "end_char", "n_tokens", "n_crossing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                row, cols = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    if not text:
                        continue
                    spans = sections(text)
                    _, first, end = tokenizer.spans(text)
                    own = attribute(first, end, spans, rule)
                    inside = np.r_[spans, [[-1, -1]]][own]
                    crossing = (own >= 0) & ((first < inside[:, 0]) | (end > inside[:, 1]))
                    n = np.bincount(own + 1, minlength=len(spans) + 1)
                    m = np.bincount(own + 1, weights=crossing, minlength=len(spans) + 1).astype(np.int64)
                    number = np.arange(-1, len(spans))
                    all_spans = np.r_[[[-1, -1]], spans]
                    keep = (number >= 0) | (n > 0)
                    row.append(np.full(keep.sum(), i))
                    cols.append(np.stack([number, all_spans[:, 0], all_spans[:, 1], n, m])[:, keep])
                if row:
                    data = np.concatenate(cols, axis=1)
                    none = data[0] < 0
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(np.concatenate(row))),
                         *[pa.array(c, pa.int64(), mask=none if k in (1, 2) else None) for k, c in enumerate(data)]],
                        names=["_id", *names])

    found = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).mapInArrow(
        run, f"_id {kind}, " + ", ".join(f"{n} bigint" for n in names))
    return found.withColumnRenamed("_id", id_col)


def count_fields(rows: DataFrame, fields: list[str], tokenizer: Tokenizer, id_col: str, separator: str = "\n",
                 rule: str = "majority") -> DataFrame:
    """Tokens by field of rows whose fields are encoded as one text, joined by ``separator``.

    (id, field, n_tokens, n_crossing) with field -1 for the separators' own tokens; null fields count as empty.
    """
    size = F.array(*[F.length(F.coalesce(F.col(f), F.lit(""))) for f in fields])
    text = F.concat_ws(separator, *[F.coalesce(F.col(f), F.lit("")) for f in fields])
    src = rows.select(F.struct(F.col(id_col).alias("id"), size.alias("size")).alias("_at"), text.alias("_text"))
    gap = len(separator)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in pieces(b):
                ids, sizes = part.column(0).field("id"), part.column(0).field("size").to_pylist()
                row, out = [], []
                for i, (size, text) in enumerate(zip(sizes, part.column(1).to_pylist())):
                    end = np.cumsum(np.array(size) + gap) - gap
                    spans = np.stack([end - size, end], axis=1)
                    full = spans[:, 0] < spans[:, 1]
                    _, first, last = tokenizer.spans(text)
                    own = attribute(first, last, spans[full], rule)
                    crossing = np.zeros(len(own), dtype=bool)
                    own = np.r_[np.flatnonzero(full), -1][own]
                    inside = spans[own]
                    crossing = (own >= 0) & ((first < inside[:, 0]) | (last > inside[:, 1]))
                    n = np.bincount(own + 1, minlength=len(size) + 1)
                    m = np.bincount(own + 1, weights=crossing, minlength=len(size) + 1).astype(np.int64)
                    row.append(np.full(len(n), i))
                    out.append(np.stack([np.arange(-1, len(size)), n, m]))
                if row:
                    data = np.concatenate(out, axis=1)
                    yield pa.RecordBatch.from_arrays([ids.take(pa.array(np.concatenate(row))), *map(pa.array, data)],
                                                     names=["_id", "field", "n_tokens", "n_crossing"])

    kind = dict(rows.select(id_col).dtypes)[id_col]
    return src.mapInArrow(run, f"_id {kind}, field bigint, n_tokens bigint, n_crossing bigint").withColumnRenamed(
        "_id", id_col)
