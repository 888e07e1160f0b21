"""Byte-level BPE as a monoid: halves are encoded on their own and joined at their borders."""

import base64
import heapq
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

#: Texts that are worked on before their ids leave a task.
ROWS = 500
#: Code points that are split and encoded at once, and ids that are decoded at once.
LEAF = 2048
#: Pieces whose ids a Python worker remembers.
REMEMBERED = 400_000
NONE = 1 << 62
#: Bytes of a piece up to which it is not halved, and ids from which on pairs wait in a heap.
LONG = 64


def read_ranks(path):
    """The content of a rank file; a few hundred kB that go to the tasks with the function."""
    with open(path, "rb") as f:
        return f.read()


def read_lines(content):
    """Tokens and their ranks."""
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, content.splitlines())}


def _sliced(batches):
    for rows in batches:
        for at in range(0, len(rows), ROWS):
            yield rows.slice(at, ROWS)


class Merges(dict):
    """Ids of pieces, worked out when first asked for. A token's id is its rank."""

    def __init__(self, content):
        super().__init__()
        self.ranks = read_lines(content)
        self.bytes = [self.ranks.get(bytes([i])) for i in range(256)]
        self.pairs, self.fitting = {}, {}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    self.pairs[left << 32 | right] = rank

    def __missing__(self, piece):
        if len(self) >= REMEMBERED:
            self.clear()
        data = piece.encode("utf-8", "replace")
        known = self.ranks.get(data)
        ids = self[piece] = (known,) if known is not None else tuple(self.halved(data))
        return ids

    def halved(self, data):
        """Ids of some bytes: those of both halves, joined."""
        if len(data) <= LONG:
            return self.merged([self.bytes[b] for b in data])
        half = len(data) // 2
        return self.joined(self.halved(data[:half]), self.halved(data[half:]))

    def joined(self, left, right):
        """Ids of two neighbouring texts from the ids of each.

        A window of ids at the border is encoded anew, and grows until both of its ends fit their neighbours. Ids are the
        encoding of their bytes if, and only if, each two neighbours are the encoding of theirs; within both sides and
        within the window that holds already, so once it holds at the window's ends, all ids outside stand.
        """
        taken = 1
        while True:
            a, b = max(0, len(left) - taken), min(len(right), taken)
            window = self.merged([self.bytes[x] for i in [*left[a:], *right[:b]] for x in self.tokens[i]])
            fits_left = a == 0 or self.fits(left[a - 1], window[0])
            if fits_left and (b == len(right) or self.fits(window[-1], right[b])):
                return [*left[:a], *window, *right[b:]]
            taken *= 2

    def fits(self, a, b):
        """Whether two ids next to each other are the encoding of their bytes."""
        key = a << 32 | b
        known = self.fitting.get(key)
        if known is None:
            if len(self.fitting) >= REMEMBERED:
                self.fitting.clear()
            both = [self.bytes[x] for x in self.tokens[a] + self.tokens[b]]
            known = self.fitting[key] = self.merged(both) == [a, b]
        return known

    def merged(self, ids):
        """Join the neighbours of least rank, leftmost first, until no two make a token."""
        if len(ids) >= LONG:
            return self._merged_long(ids)
        pair = self.pairs.get
        ranks = [pair(a << 32 | b, NONE) for a, b in zip(ids, ids[1:])]
        while ranks:
            least = min(ranks)
            if least == NONE:
                break
            at = ranks.index(least)
            ids[at : at + 2] = [least]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = pair(least << 32 | ids[at + 1], NONE)
            if at:
                ranks[at - 1] = pair(ids[at - 1] << 32 | least, NONE)
        return ids

    def _merged_long(self, ids):
        """The same with a heap of pairs and links between neighbours."""
        pair, n = self.pairs.get, len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []

        def offer(i):
            j = after[i]
            if j < n:
                rank = pair(ids[i] << 32 | ids[j])
                if rank is not None:
                    heapq.heappush(heap, (rank, i, ids[i], ids[j]))

        for i in range(n - 1):
            offer(i)
        while heap:
            rank, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = rank, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [x for x in ids if x is not None]


class Splitter:
    """Pieces of a text, one per match of the pattern, found half by half.

    A match depends on the text from where it starts to at most two code points past its end, and on three
    from its start (``'re``); with that much text behind it, it stands whatever follows. Matching has no memory,
    so where a border of the joined text meets a border of the right half, all after it stands too.
    """

    def __init__(self, pattern):
        self.find = regex.compile(pattern).findall

    def pieces(self, text):
        if len(text) <= LEAF:
            return self.find(text)
        half = len(text) // 2
        return self.join(self.pieces(text[:half]), self.pieces(text[half:]))

    def join(self, left, right):
        kept, end = len(left), 0  # code points after the kept pieces
        while kept and (end < 2 or end + len(left[kept - 1]) < 3):
            kept -= 1
            end += len(left[kept])
        tail = "".join(left[kept:])
        taken = 4
        while True:
            window = tail + "".join(right[:taken])
            whole = taken >= len(right)
            borders, at = {}, len(tail)
            for i, piece in enumerate(right[:taken]):
                borders[at] = i
                at += len(piece)
            found = self.find(window)
            if whole:
                borders[at] = len(right)
            start = 0
            for i, piece in enumerate(found):
                if start in borders and (i == 0 or whole or self._stands(found[i - 1], start, len(window))):
                    return left[:kept] + found[:i] + right[borders[start] :]
                start += len(piece)
            if whole:
                return left[:kept] + found
            taken *= 2

    @staticmethod
    def _stands(piece, end, length):
        return end + 2 <= length and end - len(piece) + 3 <= length


@lru_cache(2)
def _merges(content):
    return Merges(content)


@lru_cache(2)
def _splitter(pattern):
    return Splitter(pattern)


@lru_cache(2)
def _tokens(content):
    ranks = read_lines(content)
    tokens = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, i in ranks.items():
        tokens[i] = token
    return tokens


def encode_text(text, content, pattern):
    """Ids of one text."""
    pieces = _splitter(pattern).pieces(text or "")
    return array("i", chain.from_iterable(map(_merges(content).__getitem__, pieces)))


def decode_ids(ids, tokens):
    """Bytes of one list of ids, joined half by half."""
    if len(ids) <= LEAF:
        return b"".join([tokens[i] for i in ids])
    half = len(ids) // 2
    return decode_ids(ids[:half], tokens) + decode_ids(ids[half:], tokens)


def encode(column, content, pattern):
    """A column of texts as lists of ids, each match of ``pattern`` merged on its own.

    ``content`` is a rank file's content (``read_ranks``). Nulls and empty texts give empty lists; texts of any
    length are encoded whole. Tasks hold one Arrow batch and the remembered pieces.
    """

    @arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        merges, split = _merges(content), _splitter(pattern).pieces
        for texts in _sliced(batches):
            ids, ends = array("i"), np.zeros(len(texts) + 1, np.int32)
            for k, text in enumerate(texts):
                ids.extend(chain.from_iterable(map(merges.__getitem__, split(text.as_py() or ""))))
                ends[k + 1] = len(ids)
            yield pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(ids, np.int32)))

    return run(F.coalesce(column, F.lit("")))


def decode(column, content):
    """A column of lists of ids as bytes. Nulls give no bytes; unknown ids fail."""

    @arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tokens = _tokens(content)
        for lists in _sliced(batches):
            values, ends = lists.values, lists.offsets.to_pylist()
            texts = (decode_ids(values[a:b].to_numpy().tolist(), tokens) for a, b in zip(ends, ends[1:]))
            yield pa.array(list(texts), pa.binary())

    return run(F.coalesce(column, F.array().cast("array<int>")))
