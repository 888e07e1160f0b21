"""Boosted trees from histograms of binned features, for two or more classes.

Features are cut at quantiles of all rows, so a row is a few bytes per feature. Rows that share all bins, label and
weight are alike to every tree, so they are counted and kept as one; row sampling draws how many of them take part.
Trees grow level by level: every block of rows adds up first and second derivatives of the loss per node, feature and
bin, the sums of all blocks decide the splits, and only these sums leave the executors. Blocks are written to the
shared folder first; each round's blocks follow from the ones before and are checkpointed now and then, so lost
executors cost little.
"""

import json
import math
import os
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, DoubleType

from threatflow.plans.session import ensure_checkpoint_dir, shared_dir, written

#: Values (rows x features) in a block; rows of a block at least, where all cores get one; blocks added up in one step
#: on the driver; rounds between checkpoints; rows scored together; sets of features whose combinations are kept.
BLOCK_CELLS, LEAST_ROWS, DIRECT, KEPT_ROUNDS, SCORED, GRIDS = 4_000_000, 20_000, 16, 20, 100_000, 8


@dataclass
class Settings:
    """What training can be told, by the usual names of gradient boosting."""

    n_estimators: int = 400
    max_depth: int = 6
    learning_rate: float = 0.1
    subsample: float = 0.8
    colsample_bytree: float = 0.8
    min_child_weight: float = 1.0
    gamma: float = 0.0
    reg_alpha: float = 0.0
    reg_lambda: float = 1.0
    max_bin: int = 64
    early_stopping_rounds: int = 30
    seed: int = 42


# ------------------------------------------------------------------- trees


class Tree:
    """Nodes in the order they came about. A split sends bins above ``cut`` to the node after ``left``."""

    def __init__(self):
        self.feature, self.cut, self.left = [-1], [0], [0]
        self.value, self.gain, self.open = [0.0], [0.0], [0]

    def split(self, node, feature, cut, gain, values):
        """Split a leaf; its two new leaves."""
        left = len(self.feature)
        self.feature[node], self.cut[node], self.left[node], self.gain[node] = feature, cut, left, gain
        for value in values:
            self.feature.append(-1)
            self.cut.append(0)
            self.left.append(0)
            self.value.append(value)
            self.gain.append(0.0)
        return [left, left + 1]

    def prune(self, gamma):
        """Take back splits that gained less than ``gamma`` and lead to leaves only, from the last one up."""
        for node in reversed(range(len(self.feature))):
            if self.feature[node] >= 0 and self.gain[node] < gamma:
                if self.feature[self.left[node]] < 0 and self.feature[self.left[node] + 1] < 0:
                    self.feature[node] = -1

    def packed(self):
        """Feature, cut, left node and value of each node; a leaf is its own left node, which no bin leaves."""
        leaf = [f < 0 for f in self.feature]
        feature = np.array([0 if x else f for f, x in zip(self.feature, leaf)], np.int64)
        cut = np.array([NEVER if x else c for c, x in zip(self.cut, leaf)], np.int16)
        left = np.array([i if x else a for i, (a, x) in enumerate(zip(self.left, leaf))], np.int64)
        return feature, cut, left, np.array(self.value)


#: A cut that no bin is above.
NEVER = 32_767


def step(tree, bins, node, row):
    """Where rows at some nodes go next; rows at leaves stay. ``row`` counts the rows."""
    feature, cut, left = tree[:3]
    place = feature.take(node)
    place *= len(row)
    place += row
    return left.take(node) + (bins.ravel().take(place) > cut.take(node))


def leaves(tree, bins):
    """Each row's leaf."""
    row = np.arange(bins.shape[1])
    node = np.zeros(len(row), np.int64)
    # nodes are in the order of levels, so the deepest is last
    for _ in range(_depth(tree)):
        node = step(tree, bins, node, row)
    return node


def _depth(tree):
    depth = np.zeros(len(tree[0]), int)
    for node, left in enumerate(tree[2]):
        if left != node:
            depth[left : left + 2] = depth[node] + 1
    return int(depth.max())


# --------------------------------------------------- rows through whole trees

#: Leaves whose bits lie in a word; pairs of bins, or more, that one lookup takes at once; rows looked up together.
WORD, JOINED, LOOKED_UP = 64, 4_096, 10_000


def grouped(sizes):
    """Features dealt into groups whose bins, ``sizes`` of them each, make at most JOINED combinations, in order."""
    groups, count = [], 0
    for f, size in enumerate(sizes):
        if groups and count * size <= JOINED:
            groups[-1].append(f)
            count *= size
        else:
            groups.append([f])
            count = size
    return groups


def combined(bins, sizes, groups):
    """Each row's combination of bins in each group, counted with the first feature fastest."""
    out = np.zeros((len(groups), bins.shape[1]), np.intp)
    for code, group in zip(out, groups):
        for f in reversed(group):
            code *= sizes[f]
            code += bins[f]
    return out


def open_leaves(tree, sizes):
    """Values of a tree's leaves (word by bit), and by feature asked for the leaves open to each bin (word by bin).

    A leaf is open to the bins between the cuts on its way, and a row ends at the one leaf that is open to all its bins.
    """
    feature, cut, left, value = tree[:4]
    low, high = np.zeros((len(left), len(sizes)), np.int16), np.full((len(left), len(sizes)), NEVER, np.int16)
    ends, asked, nodes = [], set(), np.zeros(1, np.int64)
    while len(nodes):
        last = left[nodes] == nodes
        ends.append(nodes[last])
        nodes = nodes[~last]
        f, c, down = feature[nodes], cut[nodes], left[nodes]
        asked.update(f.tolist())
        for child in (down, down + 1):
            low[child], high[child] = low[nodes], high[nodes]
        high[down, f] = np.minimum(high[down, f], c)
        low[down + 1, f] = np.maximum(low[down + 1, f], c + 1)
        nodes = np.concatenate([down, down + 1])
    ends = np.concatenate(ends)
    words = -(-len(ends) // WORD)
    values = np.zeros((words, WORD + 1))
    values[:, :WORD].flat[: len(ends)] = value[ends]
    masks = {}
    for f in asked:
        bin_ = np.arange(sizes[f])[:, None]
        is_open = np.zeros((sizes[f], words * WORD), bool)
        is_open[:, : len(ends)] = (bin_ >= low[ends, f]) & (bin_ <= high[ends, f])
        masks[f] = np.ascontiguousarray(np.packbits(is_open, axis=1, bitorder="little").view("<u8").T)
    return values, masks


def add_values(margin, opened, codes, sizes, groups):
    """Add to each row's ``margin`` the value of its leaf, by a lookup per group instead of a step per level."""
    values, masks = opened
    tables = []
    for code, group in zip(codes, groups):
        if any(f in masks for f in group):
            table = np.full((len(values), 1), -1).astype("<u8")
            for f in group:
                mask = masks[f] if f in masks else np.full((len(values), sizes[f]), -1).astype("<u8")
                table = (mask[:, :, None] & table[:, None, :]).reshape(len(values), -1)
            tables.append((code, table))
    if not tables:
        margin += values[0, 0]
        return
    for start in range(0, len(margin), LOOKED_UP):
        here = slice(start, start + LOOKED_UP)
        for word, value in enumerate(values):
            found = None
            for code, table in tables:
                some = table[word].take(code[here], mode="clip")
                found = some if found is None else np.bitwise_and(found, some, out=found)
            # one bit of one word is set; below it are as many bits as its place, and 64 where a word has none
            found -= np.uint64(1)
            margin[here] += value.take(np.bitwise_count(found), mode="clip")


# ------------------------------------------------------------------ blocks


def odds(margin):
    """Probability of each class, or of class 1 if there are two."""
    if len(margin) == 1:
        return 1 / (1 + np.exp(-np.clip(margin, -500, 500)))
    up = np.exp(margin - margin.max(axis=0))
    return up / up.sum(axis=0)


def drawn(rng, count, share):
    """How many of each row's copies a sample of all copies takes."""
    if share >= 1:
        return count
    some = (rng.random(len(count)) < share).astype(np.int64)
    many = np.flatnonzero(count > 1)
    some[many] = rng.binomial(count[many], share)
    return some


class Face:
    """What one tree needs of a block: bins, derivatives and nodes of its rows (watched ones, last, have no derivatives),
    or of all combinations of the bins it may ask, with the sums of their rows; ``code`` is then each row's combination."""

    def __init__(self, bins, slope, curve, nodes, code):
        self.bins, self.slope, self.curve, self.nodes, self.code, self.done = bins, slope, curve, nodes, code, 0

    def sums(self, tree, features, level, max_bin):
        row = np.arange(self.bins.shape[1])
        while self.done < level:
            self.nodes[:] = step(tree, self.bins, self.nodes, row)
            self.done += 1
        places = tree[4]
        slot, size = np.full(len(tree[0]), -1), len(places) * max_bin
        slot[places] = np.arange(len(places)) * max_bin
        base, g, h = slot.take(self.nodes[: len(self.slope)]), self.slope, self.curve
        live = base >= 0
        here = slice(len(g)) if live.all() else np.flatnonzero(live)
        base, g, h = base[here], g[here], h[here]
        whole = np.zeros((len(features), size, 2))
        for i, f in enumerate(features):
            key = base + self.bins[f][here]
            whole[i, :, 0] = np.bincount(key, g, size)
            whole[i, :, 1] = np.bincount(key, h, size)
        return whole.reshape(len(features), len(places), max_bin, 2)

    def values(self, asked, tree):
        """Each row's value from the finished tree."""
        row = np.arange(self.bins.shape[1])
        value = tree[3].take(step(tree, self.bins, kept(asked, tree).take(self.nodes), row))
        return value if self.code is None else value.take(self.code)


class Block:
    """Some rows, watched ones last: their bins (feature by row), classes, weights, copies, and the trees' sum so far."""

    def __init__(self, number, bins, target, weight, count, watched, margin):
        self.number, self.bins, self.target, self.weight, self.count, self.margin = number, bins, target, weight, count, margin
        self.watched, self.learnt = watched, len(watched) - int(watched.sum())
        self.forget()

    def forget(self):
        self.round, self.slope, self.curve, self.nodes, self.codes = (None,) * 5
        self.faces, self.grids, self.asked = None, {}, None

    def __getstate__(self):
        empty = Block.__new__(Block)
        empty.forget()
        return {**self.__dict__, **empty.__dict__}

    def filed(self, path):
        """This block with its arrays, and those of its rounds, in files; a pass over it loads only what it touches."""
        def file(name, like):
            made = np.memmap(f"{path}-{name}", like.dtype, "w+", shape=like.shape)
            made[:] = like
            return made

        for name in ("bins", "target", "weight", "count", "watched", "margin"):
            setattr(self, name, file(name, getattr(self, name)))
        if self.learnt:
            zeros = np.zeros((len(self.margin), self.learnt))
            self.slope, self.curve = file("slope", zeros), file("curve", zeros)
        self.nodes, self.grids = file("nodes", np.zeros(self.margin.shape, np.int64)), None
        return self

    def begin(self, number, settings, chosen):
        """This round's derivatives, and each tree's face of the rows (see ``Face``), all at the root."""
        p = odds(self.margin)
        rng = np.random.default_rng([settings.seed, number, self.number])
        some = slice(self.learnt)
        weight = self.weight[some] * drawn(rng, self.count[some], settings.subsample)
        hit = self.target[some] == (np.arange(len(p))[:, None] if len(p) > 1 else 1)
        q = p[:, some]
        if self.slope is None:
            self.slope, self.curve = np.empty(q.shape), np.empty(q.shape)
        self.slope[:] = weight * (q - hit)
        self.curve[:] = weight * np.maximum(q * (1 - q) * (2 if len(p) > 1 else 1), 1e-16)
        if self.nodes is None:
            self.nodes = np.zeros(p.shape, np.int64)
        self.nodes[:] = 0
        self.faces = [self.face(k, features) for k, features in enumerate(chosen)]
        self.round = number
        return self.loss(p)

    def face(self, k, features):
        """The rows as a tree over some features sees them."""
        grid = self.grid(features)
        if grid is None:
            return Face(self.bins, self.slope[k], self.curve[k], self.nodes[k], None)
        code, bins = grid
        size = bins.shape[1]
        sums = [np.bincount(code[: self.learnt], v[k], size) for v in (self.slope, self.curve)]
        return Face(bins, *sums, np.zeros(size, np.int64), code)

    def grid(self, features):
        """Each row's combination of the features' bins, and the bins of all combinations, if these are far fewer than rows."""
        key = tuple(features)
        if self.grids is not None and key in self.grids:
            return self.grids[key]
        sizes = [int(self.bins[f].max(initial=0)) + 1 for f in key]
        found = None
        if math.prod(sizes) * 2 <= self.bins.shape[1]:
            (code,) = combined(self.bins[list(key)], sizes, [range(len(key))])
            bins = np.zeros((len(self.bins), math.prod(sizes)), np.uint8)
            stride = np.arange(bins.shape[1])
            for f, size in zip(key, sizes):
                bins[f], stride = stride % size, stride // size
            found = code, bins
        if self.grids is not None and len(self.grids) < GRIDS:
            self.grids[key] = found
        return found

    def loss(self, p):
        """Loss and weight of the watched rows."""
        some = slice(self.learnt, None)
        target, weight, q = self.target[some], self.weight[some] * self.count[some], p[:, some]
        if not len(target):
            return np.zeros(2)
        right = q[target, np.arange(len(target))] if len(q) > 1 else np.where(target == 1, q[0], 1 - q[0])
        return np.array([-(weight * np.log(np.maximum(right, 1e-15))).sum(), weight.sum()])

    def sums(self, ask):
        """Sums of derivatives per tree, open node, chosen feature and bin; at the root also the loss."""
        number, settings, trees, chosen, levels = ask
        loss = np.zeros(2)
        if self.round != number:
            loss = self.begin(number, settings, chosen)
        self.asked = trees
        return [loss, *[
            face.sums(tree, features, level, settings.max_bin) for face, tree, features, level in zip(self.faces, trees, chosen, levels)
        ]]

    def settle(self, trees):
        """Take these rows, which stand one level above the last of a round's trees, to their leaves."""
        for margin, face, asked, tree in zip(self.margin, self.faces, self.asked, trees):
            margin += face.values(asked, tree)
        self.round, self.faces = None, None

    def advanced(self, trees):
        """These rows after a round's trees."""
        margin = self.margin.copy()
        if self.codes is None:
            sizes = [int(most) + 1 for most in self.bins.max(axis=1, initial=0)]
            groups = grouped(sizes)
            self.codes = combined(self.bins, sizes, groups), sizes, groups
        for row, tree in zip(margin, trees):
            add_values(row, open_leaves(tree, self.codes[1]), *self.codes)
        after = Block(self.number, self.bins, self.target, self.weight, self.count, self.watched, margin)
        after.codes = self.codes
        return after


def kept(grown, pruned):
    """For each node of a tree as it grew, itself, or the leaf it went back into when splits were taken back."""
    place = np.arange(len(grown[0]))
    split = grown[2] != place
    if (split & (pruned[2][: len(place)] == place)).any():
        for node in np.flatnonzero(split):
            if place[node] != node or pruned[2][node] == node:
                place[grown[2][node] : grown[2][node] + 2] = place[node]
    return place


def added(a, b):
    return [x + y for x, y in zip(a, b)]


class InTask:
    """Blocks of the task that trains on them: one in memory, several in files of ``folder``, one loaded at a time."""

    def __init__(self, blocks, folder):
        self.blocks = []
        for block in blocks:
            self.blocks.append(block)
            if len(self.blocks) == 2:
                self.blocks[0].filed(os.path.join(folder, "0"))
            if len(self.blocks) > 1:
                block.filed(os.path.join(folder, str(len(self.blocks) - 1)))

    def sums(self, ask):
        whole = self.blocks[0].sums(ask)
        for block in self.blocks[1:]:
            whole = added(whole, block.sums(ask))
        return whole

    def advance(self, trees):
        for block in self.blocks:
            block.settle(trees)


class OnCluster:
    """Blocks on the executors; sums of many blocks are added up there."""

    def __init__(self, blocks):
        self.blocks, self.old, self.rounds = blocks.persist(StorageLevel.MEMORY_AND_DISK), None, 0
        self.many = blocks.getNumPartitions() > DIRECT

    def sums(self, ask):
        parts = self.blocks.map(lambda b: b.sums(ask))
        whole = parts.treeReduce(added) if self.many else parts.reduce(added)
        if self.old is not None:
            self.old.unpersist()
            self.old = None
        return whole

    def advance(self, trees):
        self.old = self.blocks
        self.blocks = self.old.map(lambda b: b.advanced(trees)).persist(StorageLevel.MEMORY_AND_DISK)
        self.rounds += 1
        if self.rounds % KEPT_ROUNDS == 0:
            self.blocks.checkpoint()

    def close(self):
        for blocks in (self.blocks, self.old):
            if blocks is not None:
                blocks.unpersist()


# ---------------------------------------------------------------- training


def _shrunk(g, alpha):
    return np.sign(g) * np.maximum(np.abs(g) - alpha, 0)


def best_splits(sums, settings):
    """For each node the gain, feature (by its place among the chosen), cut, and the values of both sides."""
    lam, alpha = settings.reg_lambda, settings.reg_alpha

    def score(g, h):
        return _shrunk(g, alpha) ** 2 / (h + lam + 1e-16)

    def value(g, h):
        return -settings.learning_rate * _shrunk(g, alpha) / (h + lam + 1e-16)

    left = np.cumsum(sums, axis=2)
    whole = left[:, :, -1:, :]
    left, right = left[:, :, :-1, :], whole - left[:, :, :-1, :]
    gain = score(left[..., 0], left[..., 1]) + score(right[..., 0], right[..., 1]) - score(whole[..., 0], whole[..., 1])
    enough = (left[..., 1] >= settings.min_child_weight) & (right[..., 1] >= settings.min_child_weight)
    gain = np.where(enough, gain, -np.inf).transpose(1, 0, 2)
    nodes, _, cuts = gain.shape
    place = gain.reshape(nodes, -1).argmax(axis=1)
    feature, cut = place // cuts, place % cuts
    at = np.arange(nodes)
    sides = [value(s[feature, at, cut, 0], s[feature, at, cut, 1]) for s in (left, right)]
    return gain[at, feature, cut], feature, cut, np.stack(sides, axis=1), value(whole[0, :, 0, 0], whole[0, :, 0, 1])


def grow(rows, settings, features, trees_each, watch):
    """Rounds of trees (packed) over ``rows`` (InTask or OnCluster), and the watched loss after each.

    With watched rows training ends when their loss has not improved for a while; trees after the best are dropped.
    """
    rounds, losses, best, stopped = [], [], 0, False
    count = max(1, int(features * settings.colsample_bytree))
    for number in range(settings.n_estimators):
        rng = np.random.default_rng([settings.seed, number])
        trees = [Tree() for _ in range(trees_each)]
        chosen = [np.sort(rng.choice(features, count, replace=False)) for _ in trees]
        for level in range(max(settings.max_depth, 1)):
            live = [i for i, t in enumerate(trees) if t.open]
            if not live:
                break
            ask = [(*t.packed(), np.array(t.open, np.int64)) for t in trees]
            loss, *sums = rows.sums((number, settings, ask, chosen, [level] * trees_each))
            if level == 0 and watch and number:
                losses.append(loss[0] / max(loss[1], 1e-16))
                best = best if losses[best] <= losses[-1] else number - 1
                if number - 1 - best >= settings.early_stopping_rounds:
                    stopped = True
                    break
            for i in live:
                tree, opened = trees[i], []
                gains, feature, cut, sides, own = best_splits(sums[i], settings)
                if level == 0:
                    tree.value[0] = float(own[0])
                if settings.max_depth > 0:
                    for j, node in enumerate(tree.open):
                        if gains[j] > 1e-12:
                            opened += tree.split(node, int(chosen[i][feature[j]]), int(cut[j]), float(gains[j]), sides[j].tolist())
                tree.open = opened
        if stopped:
            break
        for tree in trees:
            tree.prune(settings.gamma)
        rounds.append([t.packed() for t in trees])
        rows.advance(rounds[-1])
    if watch and rounds and not stopped:
        # the loss after the last round
        ask = [(*Tree().packed(), np.array([0]))] * trees_each
        loss, *_ = rows.sums((settings.n_estimators, settings, ask, [np.arange(1)] * trees_each, [0] * trees_each))
        losses.append(loss[0] / max(loss[1], 1e-16))
        best = best if losses[best] <= losses[-1] else len(losses) - 1
    return (rounds[: best + 1] if watch and rounds else rounds), losses


# ------------------------------------------------------------------- model


class BoostedTrees:
    """Trained trees: inputs and their cuts, classes, and rounds of one tree per class (one for two classes)."""

    def __init__(self, features, cuts, classes, base, rounds, scaler=None, losses=()):
        self.features, self.cuts, self.classes, self.base = list(features), cuts, classes, base
        self.rounds, self.scaler, self.losses, self.opened = rounds, scaler, list(losses), None

    def __getstate__(self):
        return {**self.__dict__, "opened": None}

    def binned(self, matrix):
        return binned(matrix, self.cuts)

    def probabilities(self, matrix):
        """Probability of each class (row by class), of class 1 alone where there are two."""
        margin = np.repeat(np.array(self.base, float)[:, None], len(matrix), axis=1)
        sizes = [len(cut) + 1 for cut in self.cuts]
        groups = grouped(sizes)
        if self.opened is None:
            self.opened = [[open_leaves(tree, sizes) for tree in trees] for trees in self.rounds]
        codes = combined(self.binned(matrix), sizes, groups)
        for trees in self.opened:
            for row, opened in zip(margin, trees):
                add_values(row, opened, codes, sizes, groups)
        return odds(margin).T

    def probability_column(self):
        """An array column of probabilities from the feature columns."""
        return probability_columns([self])

    def save(self, spark, path):
        """Write the model as two small tables below ``path``."""
        about = json.dumps({
            "features": self.features, "cuts": [list(map(float, c)) for c in self.cuts], "classes": self.classes,
            "base": list(map(float, self.base)), "scaler": self.scaler, "losses": list(map(float, self.losses)),
        })
        spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").parquet(f"{path}/about")
        rows = [(r, k, *[v.tolist() for v in t]) for r, trees in enumerate(self.rounds) for k, t in enumerate(trees)]
        kinds = "round int, class_no int, feature array<int>, cut array<int>, left array<int>, value array<double>"
        spark.createDataFrame(rows, kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/trees")

    @classmethod
    def load(cls, spark, path):
        about = json.loads(spark.read.parquet(f"{path}/about").first()["about"])
        rounds = []
        for row in spark.read.parquet(f"{path}/trees").orderBy("round", "class_no").collect():
            if row["class_no"] == 0:
                rounds.append([])
            kinds = (np.int64, np.int16, np.int64, np.float64)
            rounds[-1].append(tuple(np.array(row[n], k) for n, k in zip(("feature", "cut", "left", "value"), kinds)))
        return cls(about["features"], [np.array(c) for c in about["cuts"]], about["classes"], about["base"], rounds, about["scaler"], about["losses"])


def probability_columns(models):
    """One array column of what models with the same inputs say, one after the other.

    Batches are scored SCORED rows at a time, since a tree's lookups are made anew for each call.
    """
    inputs = F.array(*[c.cast("double") for c in scaled(models[0].features, models[0].scaler)])
    width = len(models[0].features)

    @F.arrow_udf(ArrayType(DoubleType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def scored(held):
            flat = np.concatenate([b.flatten().to_numpy(zero_copy_only=False).astype(float) for b in held])
            matrix = flat.reshape(-1, width)
            odds = np.concatenate([m.probabilities(matrix) for m in models], axis=1)
            start = 0
            for batch in held:
                some = odds[start : start + len(batch)]
                start += len(batch)
                ends = np.arange(len(some) + 1, dtype=np.int32) * odds.shape[1]
                yield pa.ListArray.from_arrays(pa.array(ends), pa.array(some.ravel()))

        held = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= SCORED:
                yield from scored(held)
                held = []
        if held:
            yield from scored(held)

    return run(inputs)


def scaled(features, scaler):
    """Feature columns, scaled if there is a scaler (feature: centre, width)."""
    plain = [F.col(f"`{f}`") for f in features]
    if scaler is None:
        return plain
    return [(c - F.lit(scaler[f][0])) / F.lit(scaler[f][1]) for f, c in zip(features, plain)]


def binned(matrix, cuts):
    """Bins of values, feature by row; missing ones lie in the lowest."""
    out = np.zeros((matrix.shape[1], matrix.shape[0]), np.uint8)
    for f, cut in enumerate(cuts):
        value = matrix[:, f]
        out[f] = np.searchsorted(cut, np.where(np.isnan(value), -np.inf, value), "right")
    return out


def quantile_cuts(rows: DataFrame, columns, max_bin):
    """Cuts of each column at quantiles of its values, from one pass over all rows."""
    shares = [i / max_bin for i in range(1, max_bin)]
    found = rows.agg(*[
        F.percentile_approx(F.when(~F.isnan(c), c), shares, 20 * max_bin).alias(f"c{i}") for i, c in enumerate(columns)
    ]).first()
    return [np.unique(np.array(found[i] or [], float)) for i in range(len(columns))]


def block_rows(width):
    return max(1, BLOCK_CELLS // max(width, 1))


#: Bins in a whole number, a byte each.
PACKED = 8


def cells(rows: DataFrame, cuts):
    """Rows of values ``x`` and other columns, each different one once with its count ``n`` and bins instead of values.

    Bins lie in columns ``b0``, ``b1``, … of PACKED bins each (see ``bin_columns``).
    """
    rest = [c for c in rows.columns if c != "x"]
    width, names = len(cuts), [f"b{i}" for i in range(-(-len(cuts) // PACKED))]

    def run(batches):
        for batch in batches:
            flat = batch.column("x").flatten().to_numpy(zero_copy_only=False).astype(float)
            wide = np.zeros((batch.num_rows, len(names) * PACKED), np.uint8)
            wide[:, :width] = binned(flat.reshape(-1, width), cuts).T
            packed = [pa.array(np.ascontiguousarray(c)) for c in wide.view("<i8").T]
            yield pa.RecordBatch.from_arrays([*packed, *[batch.column(c) for c in rest]], [*names, *rest])

    kinds = dict(rows.dtypes)
    kinds = ", ".join([*[f"{c} bigint" for c in names], *[f"{c} {kinds[c]}" for c in rest]])
    return rows.mapInArrow(run, kinds).groupBy(*names, *rest).agg(F.count(F.lit(1)).alias("n"))


def bin_columns(features):
    """The bin of each feature from ``cells``, under the feature's name."""
    return [
        F.shiftrightunsigned(f"b{i // PACKED}", 8 * (i % PACKED)).bitwiseAND(255).alias(f) for i, f in enumerate(features)
    ]


def values(features, scaler=None):
    """The values of each row as the array ``x``; missing ones are NaN."""
    return F.array(*[F.coalesce(c.cast("double"), F.lit(float("nan"))) for c in scaled(features, scaler)]).alias("x")


def _blocks_of(width, base):
    """Blocks of at most BLOCK_CELLS values from Arrow batches of cells, pickled."""

    def run(batches):
        import pickle
        import zlib

        held, count, most = [], 0, block_rows(width)

        def block(table):
            names = [c for c in table.column_names if c not in ("y", "w", "v", "n")]
            wide = np.stack([table.column(c).to_numpy() for c in names], axis=1).astype("<i8").view(np.uint8)
            bins = np.ascontiguousarray(wide[:, :width].T)
            target = table.column("y").to_numpy().astype(np.int32)
            weight = table.column("w").to_numpy().astype(float)
            times = table.column("n").to_numpy().astype(np.int64)
            watched = table.column("v").to_numpy(zero_copy_only=False).astype(bool)
            margin = np.repeat(np.array(base, float)[:, None], len(target), axis=1)
            made = (zlib.crc32(bins.tobytes()), bins, target, weight, times, watched, margin)
            return pa.RecordBatch.from_arrays([pa.array([pickle.dumps(made, 5)], pa.large_binary())], ["block"])

        for batch in batches:
            while count + batch.num_rows >= most:
                held.append(batch.slice(0, most - count))
                batch = batch.slice(most - count)
                yield block(pa.Table.from_batches(held))
                held, count = [], 0
            if batch.num_rows:
                held.append(batch)
                count += batch.num_rows
        if count:
            yield block(pa.Table.from_batches(held))

    return run


def prepare(rows: DataFrame, features, label, weight=None, scaler=None, watched=None, classes=None, max_bin=64, max_rows=None, positive_weight=None):
    """Binned blocks in the shared folder, and what a model needs besides trees.

    ``classes`` are the names of the label's values, in order, or None for a label of 0 and 1. Rows without label
    are left out. All others are used, unless the caller asks for a random sample of about ``max_rows`` of them.
    """
    spark = rows.sparkSession
    scale = None if scaler is None else {f: tuple(map(float, scaler[f])) for f in features}
    target = F.col(label).cast("int") if classes is None else F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)).cast("int") - 1
    use = rows.where(F.col(label).isNotNull()).select(
        values(features, scale),
        target.alias("y"),
        (F.lit(1.0) if weight is None else F.coalesce(F.col(weight).cast("double"), F.lit(0.0))).alias("w"),
        (F.lit(False) if watched is None else F.coalesce(F.col(watched).cast("boolean"), F.lit(False))).alias("v"),
    )
    if max_rows:
        n = use.count()
        use = use if n <= max_rows else use.sample(max_rows / n, seed=42)
    if positive_weight is not None:
        use = use.withColumn("w", F.when(F.col("y") == 1, F.col("w") * positive_weight).otherwise(F.col("w")))
    cuts = quantile_cuts(use, [F.get("x", F.lit(i)) for i in range(len(features))], max_bin)
    found = written(cells(use, cuts))
    mass = F.when(~F.col("v"), F.col("w") * F.col("n"))
    n, whole, ones = found.agg(F.count(F.lit(1)), F.sum(mass), F.sum(F.when(F.col("y") == 1, mass).otherwise(0.0))).first()
    if classes is None:
        share = min(max(ones / whole if whole else 0.5, 1e-6), 1 - 1e-6)
        base = [math.log(share / (1 - share))]
    else:
        base = [0.0] * len(classes)
    parts = max(1, math.ceil(n / block_rows(len(features))))
    if parts > 1:
        parts = max(parts, min(spark.sparkContext.defaultParallelism, math.ceil(n / LEAST_ROWS)))
    path = shared_dir(spark, "blocks")
    # the same rows in the same order each time, watched ones last; draws are cheaper where counts repeat
    keys = [c for c in found.columns if c != "n"]
    blocks = found.repartition(parts, *keys).sortWithinPartitions("v", "n", F.xxhash64(*keys), *keys)
    blocks.mapInArrow(_blocks_of(len(features), base), "block binary").write.parquet(path)
    return path, parts, BoostedTrees(features, cuts, classes, base, [], scale)


def _block(row):
    import pickle

    return Block(*pickle.loads(row[0]))


def blocks_rdd(spark, path):
    """The blocks written by ``prepare``, one file a task."""
    return spark.read.parquet(path).rdd.map(_block)


def train(rows: DataFrame, features, label, weight=None, scaler=None, watched=None, classes=None, max_rows=None, positive_weight=None, **params):
    """Boosted trees for a label of 0 and 1, or for named ``classes``; see ``Settings`` for the parameters.

    With ``watched`` (a column that is true for rows to watch) these rows aren't trained on, and training ends when
    their loss stops improving. If all rows fit into one block, its task trains alone, as there is nothing to add up.
    """
    spark = rows.sparkSession
    settings = of(params)
    path, parts, model = prepare(rows, features, label, weight, scaler, watched, classes, settings.max_bin, max_rows, positive_weight)
    ensure_checkpoint_dir(spark)
    blocks = blocks_rdd(spark, path)
    width, each, watch = len(model.features), len(model.base), watched is not None
    if parts == 1:
        done = blocks.map(lambda b: grow(InTask([b], None), settings, width, each, watch)).collect()
    else:
        held = OnCluster(blocks)
        try:
            done = [grow(held, settings, width, each, watch)]
        finally:
            held.close()
    model.rounds, model.losses = done[0] if done else ([], [])
    return model


def of(params):
    """Settings from names and values; whole numbers stay whole. A bin is a byte, so there are 256 at most."""
    kinds = {f.name: type(f.default) for f in fields(Settings)}
    made = Settings(**{k: kinds[k](v) if k in kinds else v for k, v in params.items()})
    if not 2 <= made.max_bin <= 256:
        raise ValueError(f"max_bin {made.max_bin} is not between 2 and 256")
    return made


def trials(spark, path, width, each, watch, settings):
    """Rounds of trees for each of many settings over all blocks, a task each; an RDD of numbers and rounds."""
    # the longest first, so that none begins when all others are done
    order = sorted(range(len(settings)), key=lambda i: -settings[i].n_estimators * settings[i].max_depth)

    def fit(place, blocks):
        with tempfile.TemporaryDirectory(prefix="trial-") as folder:
            rows = InTask((_block(b) for b in blocks), folder)
            if rows.blocks:
                yield order[place], grow(rows, settings[order[place]], width, each, watch)

    # each task reads the blocks from their folder, so no copy of them is made
    blocks = spark.read.parquet(path).rdd.coalesce(1)
    return spark.sparkContext.union([blocks] * len(settings)).mapPartitionsWithIndex(fit)
