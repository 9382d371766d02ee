"""Toxicity: a bidirectional GRU with attention pooling over word and character inputs, trained in numpy.

Every word enters as its hashed word embedding beside the mean of its hashed character n-gram embeddings (with
word boundaries), both over all its characters; runs without white space are cut into several words. A text is read in windows of ``WINDOW`` words, each overlapping the next by half; the network scores
every window, and the text's score comes from its highest window, calibrated on texts kept out of training.

Training is multiple-instance: labels belong to texts, so a first pass gives every window its text's label and
the later passes train on the highest window of each text only (for clean texts: the one that is most
wrongly high). It runs on a bounded sample of labelled rows, ``PER_LABEL`` of each label, for a fixed number of steps.
"""

from __future__ import annotations

import re
import unicodedata
import warnings
from collections import defaultdict
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Platt, filter_texts, labelled_sample, map_texts, sigmoid

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED, ATTEND = 8, 8, 8
WORD_ROWS, GRAM_ROWS = 1 << 14, 1 << 15
NGRAMS = (3, 4, 5)
PER_LABEL = 1500  # training rows of each label at most
BATCH, NOISY_STEPS, BAG_STEPS = 160, 120, 120
CHUNK = 2048  # windows scored at once
LONGEST, PIECE, STEP = 24, 16, 12  # characters of a word at most; of a piece of a longer one; from piece to piece
# vowel signs and accents belong to their word, like letters
_MARKS = "".join(c for c in map(chr, [*range(0x300, 0x1F000), *range(0xE0100, 0xE01F0)])
                 if unicodedata.category(c)[0] == "M")
_APART = f"(?:[^\\w{_MARKS}]|_)+"
_BREAK = re.compile(_APART)
_JOINS = {ord(c): " " for c in "_-./\\|+*=~:;,!?"}  # words written together with one of these are words of their own
_BARE = re.compile(f"^{_APART}|{_APART}$")


def words_of(text: str | None) -> list[str]:
    """Lower-case words between white space or joins; punctuation at their ends is taken off before they are looked up.

    Of a run of more than ``LONGEST`` characters every part between punctuation is a word, and a part that is still longer
    (a script without spaces) is cut into pieces that overlap by the longest n-gram less one, so none is left out.
    """
    words = (text or "").lower().translate(_JOINS).split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    found = []
    for w in words:
        if len(w) <= LONGEST:
            found.append(w)
            continue
        for part in _BREAK.split(w):
            if len(part) > LONGEST:
                found += [part[i:i + PIECE] for i in range(0, len(part) - PIECE + STEP, STEP)]
            elif part:
                found.append(part)
    return found


def _gram_ids(words: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each n-gram length: the hashed rows of all words in a line, the words that have any, how many each has."""
    code = np.frombuffer("".join([f"<{w}>" for w in words]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    size = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    left = np.repeat(np.cumsum(size), size) - np.arange(len(code))  # characters up to the word's end
    found = []
    for k in NGRAMS:
        h = np.full(max(0, len(code) - k + 1), k, dtype=np.uint64)
        for j in range(k):
            h = (h ^ code[j:len(code) - k + 1 + j]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
        some = np.flatnonzero(size >= k)
        ids = (h[left[:len(h)] >= k] >> np.uint64(7)) % np.uint64(GRAM_ROWS)
        found.append((ids.astype(np.int64), some, size[some] - k + 1))
    return found


def _word_ids(words: list[str]) -> np.ndarray:
    """Rows of whole words: an FNV-like hash over the UTF-8 bytes, computed per word position in numpy."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    h = np.full(len(words), 0xCBF29CE484222325, dtype=np.uint64)
    some, at = np.arange(len(raw)), 0
    while len(some):  # 24 bytes of every word, then the next 24 of the longer ones
        part = b"".join([raw[i][at:at + 24].ljust(24, b"\0") for i in some])
        grid = np.frombuffer(part, dtype=np.uint8).reshape(-1, 24).view(np.uint64)
        for j in range(3):
            h[some] = (h[some] ^ grid[:, j]) * np.uint64(0x9E3779B97F4A7C15)
            h[some] ^= h[some] >> np.uint64(31)
        at += 24
        some = some[size[some] > at]
    return (h % np.uint64(WORD_ROWS)).astype(np.int64)


class Windows:
    """The texts in blocks of ``STRIDE`` numbers of their distinct words, padded with one number more.

    A window is two neighbouring blocks of a text. A short text has one window; the last one reaches the end.
    """

    def __init__(self, texts: list):
        seen: defaultdict[str, int] = defaultdict()
        seen.default_factory = seen.__len__
        lines = [list(map(seen.__getitem__, words_of(t))) for t in texts]
        flat = np.fromiter(chain.from_iterable(lines), dtype=np.int64, count=sum(map(len, lines)))
        self.words = list(seen)
        pad = len(self.words)
        n = np.fromiter(map(len, lines), dtype=np.int64, count=len(lines))
        blocks = np.maximum(2, -(-n // STRIDE))
        self.blocks = np.full((int(blocks.sum()), STRIDE), pad, dtype=np.int64)
        begin = np.cumsum(blocks) - blocks
        self.blocks.ravel()[np.arange(len(flat)) + np.repeat(begin * STRIDE - (np.cumsum(n) - n), n)] = flat
        self.count = blocks - 1
        self.first = np.cumsum(self.count) - self.count
        self.text = np.repeat(np.arange(len(lines)), self.count)
        #: the first block of every window
        self.at = np.arange(len(self.text)) - np.repeat(self.first - begin, self.count)

    def rows(self, which: np.ndarray) -> np.ndarray:
        """Word numbers of some windows."""
        at = self.at[which]
        return np.concatenate([self.blocks[at], self.blocks[at + 1]], axis=1)


class BiGru:
    """Parameters and passes of the network."""

    def __init__(self, seed: int = 7):
        g = np.random.default_rng(seed)
        def init(*shape):
            return (g.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        # words never met add nothing; n-grams begin small
        self.p = {"word": np.zeros((WORD_ROWS, EMBED), np.float32), "gram": init(GRAM_ROWS, EMBED) * 9,
                  "Wa": init(2 * HIDDEN, ATTEND), "ba": np.zeros(ATTEND, np.float32), "va": init(ATTEND),
                  "w": init(2 * HIDDEN), "b": np.zeros(1, np.float32)}
        for d in "fb":
            self.p |= {"W" + d: init(2 * EMBED, 3 * HIDDEN), "U" + d: init(HIDDEN, 3 * HIDDEN),
                       "c" + d: np.zeros(3 * HIDDEN, np.float32), "n" + d: np.zeros(HIDDEN, np.float32)}

    def vectors(self, words: list[str]) -> tuple[np.ndarray, tuple]:
        """Input vector of each distinct word, a zero row last for padding."""
        x = np.zeros((len(words) + 1, 2 * EMBED), np.float32)
        if not words:
            return x, (np.zeros(0, np.int64), [], np.ones(0))
        bare = [w if w.isalpha() else _BARE.sub("", w) for w in words]
        wid, grams, size = _word_ids(bare), _gram_ids(bare), np.zeros(len(words))
        x[:-1, :EMBED] = self.p["word"].take(wid, axis=0)
        for ids, some, n in grams:
            if len(some):
                x[some, EMBED:] += np.add.reduceat(self.p["gram"].take(ids, axis=0), np.cumsum(n) - n, axis=0)
                size[some] += n
        size = np.maximum(size, 1).astype(np.float32)
        x[:-1, EMBED:] /= size[:, None]
        return x, (wid, grams, size)

    def _run(self, d: str, table: np.ndarray, rows: np.ndarray, keep: list | None) -> np.ndarray:
        """States (time, window, hidden) of one direction; padding leaves the state as it is."""
        U, n_bias, H = self.p["U" + d], self.p["n" + d], HIDDEN
        h = np.zeros((len(rows), H), np.float32)
        out = np.empty((WINDOW, len(rows), H), np.float32)
        pad = len(table) - 1
        full = not (rows[:, -1] == pad).any()
        for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
            x, u = table[rows[:, t]], h @ U
            gate = x[:, :2 * H] + u[:, :2 * H]
            np.negative(gate, out=gate)
            np.exp(gate, out=gate)
            gate += 1
            np.reciprocal(gate, out=gate)
            r, z = gate[:, :H], gate[:, H:]
            un = u[:, 2 * H:] + n_bias
            n = np.tanh(x[:, 2 * H:] + r * un)
            new = n + z * (h - n)
            if not full:
                new = np.where((rows[:, t] == pad)[:, None], h, new)
            if keep is not None:
                keep.append((t, h, r, z, n, un))
            h = out[t] = new
        return out

    def tables(self, x: np.ndarray) -> dict[str, np.ndarray]:
        return {d: x @ self.p["W" + d] + self.p["c" + d] for d in "fb"}

    def forward(self, tables: dict, rows: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """A logit for every window."""
        pad = len(tables["f"]) - 1
        steps = {d: [] if keep is not None else None for d in "fb"}
        states = np.concatenate([self._run(d, tables[d], rows, steps[d]) for d in "fb"], axis=2)
        u = np.tanh(states @ self.p["Wa"] + self.p["ba"])
        e = u @ self.p["va"]
        e = np.where(rows.T == pad, np.float32(-30), e)
        a = np.exp(e - e.max(axis=0))
        a /= a.sum(axis=0)
        c = np.einsum("tb,tbh->bh", a, states)
        if keep is not None:
            keep |= {"steps": steps, "states": states, "u": u, "a": a, "c": c}
        return c @ self.p["w"] + self.p["b"][0]

    def logits(self, win: Windows) -> np.ndarray:
        """A logit for every window: the same passes as forward(), with features before windows in memory."""
        x = self.vectors(win.words)[0]
        table = np.concatenate([t for t in self.tables(x).values()], axis=1)
        table[-1] = 0
        table[-1, [*range(HIDDEN, 2 * HIDDEN), *range(4 * HIDDEN, 5 * HIDDEN)]] = 60  # padding: update gate 1, the state stays
        out = [np.zeros(0, np.float32)]
        for i in range(0, len(win.blocks) - 1, CHUNK):
            ids = win.blocks[i:i + CHUNK + 1]
            xs = np.ascontiguousarray(table.take(ids.ravel(), axis=0).reshape(len(ids), STRIDE, -1).transpose(1, 2, 0))
            skip = np.where(ids.T == len(win.words), np.float32(-30), np.float32(0))
            out.append(self._pairs(xs, skip))
        return np.concatenate(out)[win.at]

    def _pairs(self, xs: np.ndarray, skip: np.ndarray) -> np.ndarray:
        """Logits of every two neighbouring blocks; xs: (place in block, gates of both directions, block)."""
        n = xs.shape[2] - 1
        states = np.empty((WINDOW, 2 * HIDDEN, n), np.float32)
        for i, d in enumerate("fb"):
            ut, bias = np.ascontiguousarray(self.p["U" + d].T), self.p["n" + d][:, None]
            h = np.zeros((HIDDEN, n), np.float32)
            for t in range(WINDOW) if d == "f" else range(WINDOW - 1, -1, -1):
                half, place = divmod(t, STRIDE)
                x = xs[place, 3 * HIDDEN * i:3 * HIDDEN * (i + 1), half:half + n]
                u = ut @ h
                gate, new = u[:2 * HIDDEN], u[2 * HIDDEN:]
                gate += x[:2 * HIDDEN]
                np.negative(gate, out=gate)
                np.exp(gate, out=gate)
                gate += 1
                np.reciprocal(gate, out=gate)
                new += bias
                new *= gate[:HIDDEN]
                new += x[2 * HIDDEN:]
                np.tanh(new, out=new)
                h = np.subtract(h, new, out=states[t, HIDDEN * i:HIDDEN * (i + 1)])
                h *= gate[HIDDEN:]
                h += new
        wa, ba = np.ascontiguousarray(self.p["Wa"].T), self.p["ba"][:, None]
        total, pooled = np.zeros(n, np.float32), np.zeros((2 * HIDDEN, n), np.float32)
        for t in range(WINDOW):
            half, place = divmod(t, STRIDE)
            a = np.exp(self.p["va"] @ np.tanh(wa @ states[t] + ba) + skip[place, half:half + n])
            total += a
            pooled += a * states[t]
        return self.p["w"] @ pooled / np.maximum(total, np.float32(1e-20)) + self.p["b"][0]

    def step(self, words: list[str], rows: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean logistic loss."""
        H, p, k, g = HIDDEN, self.p, {}, {}
        x, (wid, grams, size) = self.vectors(words)
        tables = self.tables(x)
        out = self.forward(tables, rows, k)
        dl = ((sigmoid(out) - y) / len(y)).astype(np.float32)
        g["w"], g["b"] = k["c"].T @ dl, np.array([dl.sum()], np.float32)
        dc = dl[:, None] * p["w"]
        da = np.einsum("bh,tbh->tb", dc, k["states"])
        de = k["a"] * (da - (k["a"] * da).sum(axis=0))
        du = de[:, :, None] * p["va"] * (1 - k["u"] ** 2)
        g["va"] = np.einsum("tb,tba->a", de, k["u"])
        g["Wa"] = np.einsum("tbh,tba->ha", k["states"], du, optimize=True)
        g["ba"] = du.sum(axis=(0, 1))
        ds = k["a"][:, :, None] * dc + du @ p["Wa"].T
        dx = np.zeros_like(x)
        pad = len(x) - 1
        for i, d in enumerate("fb"):
            dh = np.zeros((len(rows), H), np.float32)
            dU, dn, dt = np.zeros_like(p["U" + d]), np.zeros(H, np.float32), np.zeros_like(tables[d])
            for t, h, r, z, n, un in reversed(k["steps"][d]):
                live = (rows[:, t] != pad)[:, None]
                dh = dh + ds[t][:, i * H:(i + 1) * H]
                dnew = dh * live
                dpn = dnew * (1 - z) * (1 - n * n)
                dz = dnew * (h - n) * z * (1 - z)
                dr = dpn * un * r * (1 - r)
                dun = dpn * r
                back = np.concatenate([dr, dz, dun], axis=1)
                np.add.at(dt, rows[:, t], np.concatenate([dr, dz, dpn], axis=1))
                dU += h.T @ back
                dn += dun.sum(axis=0)
                dh = np.where(live, dnew * z, dh) + back @ p["U" + d].T
            dt[pad] = 0
            g["U" + d], g["n" + d], g["c" + d], g["W" + d] = dU, dn, dt.sum(axis=0), x.T @ dt
            dx += dt @ p["W" + d].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], wid, dx[:-1, :EMBED])
        for ids, some, n in grams:
            np.add.at(g["gram"], ids, np.repeat(dx[some, EMBED:] / size[some, None], n, axis=0))
        return g


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))

    def __call__(self, g: dict) -> None:
        self.n += 1
        norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
        for k, x in g.items():
            x = x * np.float32(min(1, 5 / (norm + 1e-9)))
            self.m[k] += 0.1 * (x - self.m[k])
            self.v[k] += 0.01 * (x * x - self.v[k])
            self.p[k] -= np.float32(self.rate) * (self.m[k] / (1 - 0.9 ** self.n)) / (
                np.sqrt(self.v[k] / (1 - 0.99 ** self.n)) + np.float32(1e-8))


class ToxicityModel:
    """fit() on toxic and clean texts; score() gives the probability of label 1 (toxic)."""

    def fit(self, toxic: list[str], clean: list[str], share: float | None = None, seed: int = 11) -> ToxicityModel:
        """share: of toxic rows among all labelled ones, for the calibration (None: as in the sample)."""
        self.net, self.curve = BiGru(), None
        if not toxic or not clean:  # nothing to tell apart: the share of toxic rows
            self.prior = float(len(toxic) > 0)
            warnings.warn(f"only one label to learn from: every score is {self.prior}", stacklevel=2)
            return self
        g = np.random.default_rng(seed)
        # a quarter of the texts calibrates
        train, cal = ([t for i, t in enumerate(toxic) if (i % 4 == 3) == c] for c in (False, True))
        train0, cal0 = ([t for i, t in enumerate(clean) if (i % 4 == 3) == c] for c in (False, True))
        texts, y = train + train0, np.array([1] * len(train) + [0] * len(train0), dtype=np.float32)
        win = Windows(texts)
        of = y[win.text]
        sides = [np.flatnonzero(of == c) for c in (0, 1)]
        fit = Adam(self.net.p, 0.02)
        for _ in range(NOISY_STEPS):
            self._train(fit, win, np.concatenate([g.choice(s, BATCH // 2) for s in sides]), of)
        bags = [np.flatnonzero(y == c) for c in (0, 1)]
        fit.rate = 0.01
        for i in range(BAG_STEPS):
            if i % 30 == 0:  # the highest windows so far
                high = self.net.logits(win)
                top = np.array([win.first[j] + np.argmax(high[win.first[j]:win.first[j] + win.count[j]])
                                for j in range(len(texts))])
                hard = sides[0][np.argsort(-high[sides[0]])[:4 * BATCH]]
            pick = np.concatenate([top[g.choice(bags[1], BATCH // 2)], top[g.choice(bags[0], BATCH // 4)],
                                   g.choice(hard, BATCH // 8), g.choice(sides[0], BATCH // 8)])
            self._train(fit, win, pick, of)
        rest, truth = (cal + cal0, [1] * len(cal) + [0] * len(cal0)) if cal and cal0 else (texts, y)
        self.curve = Platt().fit(self.features(rest), np.array(truth)).towards(share, np.mean(truth))
        return self

    def _train(self, fit: Adam, win: Windows, pick: np.ndarray, of: np.ndarray) -> None:
        used, rows = np.unique(np.r_[win.rows(pick).ravel(), len(win.words)], return_inverse=True)
        fit(self.net.step([win.words[i] for i in used[:-1]], rows[:-1].reshape(-1, WINDOW), of[pick]))

    def features(self, texts: list) -> np.ndarray:
        """The highest window's logit of every text."""
        win = Windows(texts)
        return np.maximum.reduceat(self.net.logits(win), win.first)[:, None].astype(np.float64)

    def score(self, texts: list) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        if self.curve is None:
            return np.full(len(texts), self.prior)
        return self.curve(np.clip(self.features(texts), -20, 20))


def fit(docs: DataFrame, marks: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic",
        per_label: int = PER_LABEL) -> ToxicityModel:
    """Train on a bounded sample of the rows that ``marks`` (id, label) labels: at most ``per_label`` of each label."""
    found = labelled_sample(docs, marks, id_col, text, label, per_label, [1, 0])
    share = marks.agg(F.avg(F.col(label).cast("double"))).first()[0]
    return ToxicityModel().fit(found[1], found[0], share)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row: probability that the whole text is toxic.

    Null, empty and wordless texts are one window of padding and get that window's score.
    """
    return map_texts(docs, id_col, text_col, "score double", lambda texts: [pa.array(model.score(texts))])


def keep_clean(docs: DataFrame, model: ToxicityModel, text_col: str = "text", most: float = 0.3) -> DataFrame:
    """The rows, whole, whose score is below ``most``."""
    return filter_texts(docs, text_col, lambda texts: model.score(texts) < most)
