"""A quality classifier: a generalised additive model with pairwise interactions."""

from collections.abc import Iterator
from itertools import islice
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

FEATURES = (
    "log_bytes", "lower", "upper", "digit", "stop", "symbol", "high", "log_words", "word_length",
    "distinct_words", "repeated_next", "lines_per_word", "distinct_lines", "end_marks",
)

#: Labelled rows a model is fitted on at most, taken by a hash of their ids.
TRAIN_ROWS = 20_000


def _classes():
    """What each byte counts as: the columns lower, upper, digit, stop, symbol, high; white space last."""
    kinds = np.full(256, 6, np.uint8)
    for i in range(33, 256):
        c = chr(i)
        kinds[i] = (
            5 if i > 127 else 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3 if c in ".,;:!?'\"-()" else 4
        )
    return kinds


KINDS = _classes()


def features(text):
    """The numbers of one text, all of it, in the order of ``FEATURES``."""
    raw = text.encode("utf-8", "replace")
    n = max(len(raw), 1)
    kinds = np.bincount(KINDS[np.frombuffer(raw, np.uint8)], minlength=7) / n
    words = text.split()
    w = max(len(words), 1)
    lines = text.split("\n")
    return (
        np.log1p(len(raw)), *kinds[:6], np.log1p(len(words)), (n - kinds[6] * n) / w,
        len(set(words)) / w, sum(map(eq, words, islice(words, 1, None))) / w, len(lines) / w,
        len(set(lines)) / len(lines), (text.count(". ") + text.count(".\n")) / w,
    )


def measured(column):
    """A column of texts as lists of numbers; nulls read as empty."""

    @arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t.as_py()) for t in texts], pa.list_(pa.float64()))

    return run(F.coalesce(column, F.lit("")))


class Additive:
    """Log-odds as a sum of lookup tables: one per feature, and one per chosen pair of features."""

    def __init__(self, rounds=120, pair_rounds=60, rate=0.15, bins=48, pair_bins=10, pairs=5, smooth=5.0):
        self.rounds, self.pair_rounds, self.rate, self.smooth = rounds, pair_rounds, rate, smooth
        self.bins, self.pair_bins, self.pairs = bins, pair_bins, pairs

    def fit(self, x, y):
        """Cyclic boosting: in each round every feature's table gets one shallow tree's step; then the pairs
        with the best trees on what is left get theirs."""
        n, width = x.shape
        share = (y.sum() + 1) / (n + 2)
        self.base = float(np.log(share / (1 - share)))
        self.cuts = [self._cuts(x[:, f], self.bins) for f in range(width)]
        self.wide = [self._cuts(x[:, f], self.pair_bins) for f in range(width)]
        self.tables = [np.zeros(len(c) + 1) for c in self.cuts]
        self.pair_tables = {}
        if n == 0 or y.min() == y.max():
            return self
        at = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.cuts)]
        odds = np.full(n, self.base)
        for _ in range(self.rounds):
            for f in range(width):
                odds += self._step(self.tables[f], at[f], odds, y, self._line_tree)
        coarse = [np.searchsorted(c, x[:, f], "right") for f, c in enumerate(self.wide)]
        gains = {}
        for a in range(width):
            for b in range(a + 1, width):
                size = (len(self.wide[a]) + 1, len(self.wide[b]) + 1)
                gains[a, b] = self._grid_tree(*self._sums(coarse[a] * size[1] + coarse[b], odds, y, size))[1]
        chosen = sorted(gains, key=lambda p: (-gains[p], p))[: self.pairs]
        for a, b in chosen:
            self.pair_tables[a, b] = np.zeros((len(self.wide[a]) + 1, len(self.wide[b]) + 1))
        for _ in range(self.pair_rounds):
            for a, b in chosen:
                table = self.pair_tables[a, b]
                odds += self._step(table, coarse[a] * table.shape[1] + coarse[b], odds, y, self._grid_tree)
        return self

    @staticmethod
    def _cuts(values, bins):
        return np.unique(np.quantile(values, np.arange(1, bins) / bins)) if len(values) else np.zeros(0)

    def _sums(self, at, odds, y, shape):
        p = 1 / (1 + np.exp(-odds))
        size = int(np.prod(shape))
        slope = np.bincount(at, y - p, size).reshape(shape)
        curve = np.bincount(at, p * (1 - p), size).reshape(shape)
        return slope, curve

    def _step(self, table, at, odds, y, tree):
        step = self.rate * tree(*self._sums(at, odds, y, table.shape))[0]
        table += step
        return step.ravel()[at]

    def _line_tree(self, slope, curve, depth=2):
        """The Newton step of a tree over one row of bins: values per bin, and the gain."""
        g, h = slope.sum(), curve.sum()
        whole, flat = g * g / (h + self.smooth), np.full(len(slope), g / (h + self.smooth))
        if depth == 0 or len(slope) < 2:
            return flat, whole
        left_g, left_h = np.cumsum(slope)[:-1], np.cumsum(curve)[:-1]
        gains = left_g**2 / (left_h + self.smooth) + (g - left_g) ** 2 / (h - left_h + self.smooth)
        cut = int(np.argmax(gains)) + 1
        left, a = self._line_tree(slope[:cut], curve[:cut], depth - 1)
        right, b = self._line_tree(slope[cut:], curve[cut:], depth - 1)
        return np.concatenate([left, right]), a + b

    def _grid_tree(self, slope, curve):
        """The Newton step of the best cut into four quarters of a grid, and its gain."""
        g, h = (np.cumsum(np.cumsum(v, 0), 1) for v in (slope, curve))
        if min(g.shape) < 2:
            return np.zeros(g.shape), 0.0
        quarters = [
            (
                v[:-1, :-1],
                v[:-1, -1:] - v[:-1, :-1],
                v[-1:, :-1] - v[:-1, :-1],
                v[-1:, -1:] - v[:-1, -1:] - v[-1:, :-1] + v[:-1, :-1],
            )
            for v in (g, h)
        ]
        gains = sum(a**2 / (np.maximum(b, 0) + self.smooth) for a, b in zip(*quarters))
        i, j = np.unravel_index(int(np.argmax(gains)), gains.shape)
        values = [a[i, j] / (max(b[i, j], 0) + self.smooth) for a, b in zip(*quarters)]
        step = np.empty(g.shape)
        step[: i + 1, : j + 1], step[: i + 1, j + 1 :] = values[0], values[1]
        step[i + 1 :, : j + 1], step[i + 1 :, j + 1 :] = values[2], values[3]
        return step, float(gains[i, j])

    def scores(self, x):
        """Probability of label 1 for each row: bins looked up and added."""
        odds = np.full(len(x), self.base)
        for f, table in enumerate(self.tables):
            odds += table[np.searchsorted(self.cuts[f], x[:, f], "right")]
        for (a, b), table in self.pair_tables.items():
            odds += table[
                np.searchsorted(self.wide[a], x[:, a], "right"), np.searchsorted(self.wide[b], x[:, b], "right")
            ]
        return 1 / (1 + np.exp(-odds))


def held_out(key):
    """Whether a row is kept from training: the crc32 of its key as text is a multiple of 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(docs, labels, text="text", key="doc_id", label="quality", rows=TRAIN_ROWS, **settings):
    """Fit a model on at most ``rows`` labelled rows that are not held out.

    Keys and then rows are chosen by hashes of key and text, so the choice does not depend on their order; equal
    rows count once. At most ``rows`` keys and places are broadcast, and as many short lists of numbers collected,
    however often a key occurs. Labels other than 0 and 1 and labels without a text are left out; without both
    classes the model is constant.
    """
    chosen = (
        labels.where(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(key))
        .select(F.col(key).alias("_key"), F.col(label).cast("double").alias("_label"))
        .distinct()
        .orderBy(F.xxhash64("_key"), "_key", "_label")
        .limit(rows)
    )
    texts = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"), F.xxhash64(F.lit(1), text).alias("_mark"))
    places = texts.select("_key", "_mark").join(F.broadcast(chosen), "_key").distinct()
    places = places.orderBy(F.xxhash64("_mark", "_key"), "_key", "_mark", "_label").limit(rows)
    joined = texts.join(F.broadcast(places), ["_key", "_mark"])
    measures = joined.select("_key", "_mark", "_label", measured(F.col("_text")).alias("_x"))
    got = measures.dropDuplicates(["_key", "_mark", "_label"]).select("_key", "_label", "_x").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2]))
    x = np.array([r[2] for r in got], float).reshape(len(got), len(FEATURES))
    return Additive(**settings).fit(x, np.array([r[1] for r in got], float))


def score(column, model):
    """A column of texts as scores from 0 to 1; nulls read as empty."""

    @arrow_udf("double")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            x = np.array([features(t.as_py()) for t in texts], float).reshape(len(texts), len(FEATURES))
            yield pa.array(model.scores(x))

    return run(F.coalesce(column, F.lit("")))
