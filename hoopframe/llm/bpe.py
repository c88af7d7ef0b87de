"""Byte-level BPE encoding and decoding in numpy.

Texts are cut by the tokenizer's pattern. The distinct pieces of a batch are laid out in
padded matrices, bucketed by length; every round each row merges its leftmost pair of least
rank, found through a hash table of pairs, rows are compacted by one column, and finished
rows leave. Piece results are shared by all texts of a worker.
"""

from __future__ import annotations

import base64
import heapq
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import id_text, slices, small_batches

NONE = np.int32(2**31 - 1)
#: Pieces above this length merge through a heap instead of a matrix: the same merges in n log n steps.
LONG = 2048
#: Pieces kept for later batches of a worker, and matrix rows merged together.
HELD, ROWS = 300_000, 16_384


class Vocabulary:
    """Ranks of byte strings, with a hash table (a, b) -> rank of every pair that may merge."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.ranks = {base64.b64decode(t): int(r) for t, r in pairs}
        self.pieces: list[bytes] = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            self.pieces[r] = t
        self.single = np.array([self.ranks.get(bytes([i]), -1) for i in range(256)], np.int32)
        left, right, whole = [], [], []
        for t, r in self.ranks.items():
            for i in range(1, len(t)):
                a, b = self.ranks.get(t[:i]), self.ranks.get(t[i:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    whole.append(r)
        keys = self._key(np.array(left, np.uint64), np.array(right, np.uint64))
        bits = max(4, (4 * len(keys)).bit_length())
        self._shift, self._mask = np.uint64(64 - bits), np.uint64((1 << bits) - 1)
        self._keys = np.zeros(1 << bits, np.uint64)
        self._vals = np.full(1 << bits, NONE, np.int32)
        slot, todo = self._slot(keys), np.arange(len(keys))
        vals = np.array(whole, np.int32)
        while len(todo):
            free = todo[self._keys[slot[todo]] == 0]
            _, at = np.unique(slot[free], return_index=True)
            put = free[at]
            self._keys[slot[put]], self._vals[slot[put]] = keys[put], vals[put]
            todo = np.setdiff1d(todo, put, assume_unique=True)
            slot[todo] = (slot[todo] + np.uint64(1)) & self._mask

    @staticmethod
    def _key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(32)) + b.astype(np.uint64) + np.uint64(1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return (keys * np.uint64(0x9E3779B97F4A7C15)) >> self._shift

    def lookup(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where it can't merge. Negative ids (padding) never merge."""
        keys = self._key(a, b)
        slot = self._slot(keys)
        seen = self._keys[slot]
        out = np.where(seen == keys, self._vals[slot], NONE)
        todo = np.flatnonzero((seen != keys) & (seen != 0))
        while len(todo):
            slot[todo] = (slot[todo] + np.uint64(1)) & self._mask
            seen = self._keys[slot[todo]]
            hit = seen == keys[todo]
            out[todo[hit]] = self._vals[slot[todo[hit]]]
            todo = todo[~hit & (seen != 0)]
        out[(a < 0) | (b < 0)] = NONE
        return out

    def merge_rows(self, block: list[bytes]) -> list[np.ndarray]:
        """Ids of pieces of similar length: one matrix, one merge a row and round."""
        lengths = np.array([len(p) for p in block])
        width = int(lengths.max())
        flat = self.single[np.frombuffer(b"".join(block), np.uint8)]
        ids = np.full((len(block), width), -1, np.int32)
        ids[np.arange(width) < lengths[:, None]] = flat
        ranks = self.lookup(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(block), width - 1)
        out: list = [None] * len(block)
        live = np.arange(len(block))
        while len(live):
            at = ranks.argmin(1) if ranks.shape[1] else np.zeros(len(live), np.int64)
            rows = np.arange(len(live))
            best = ranks[rows, at] if ranks.shape[1] else np.full(len(live), NONE)
            done = best == NONE
            if done.any():
                for r in np.flatnonzero(done):
                    row = ids[r]
                    out[live[r]] = row[row >= 0].copy()
                keep = ~done
                live, ids, ranks, at, best = live[keep], ids[keep], ranks[keep], at[keep], best[keep]
                if not len(live):
                    break
                rows = np.arange(len(live))
            ids[rows, at] = best
            columns = np.arange(ids.shape[1] - 1)
            ids = np.where(columns > at[:, None], ids[:, 1:], ids[:, :-1])
            if ranks.shape[1] > 1:
                columns = columns[:-1]
                ranks = np.where(columns > at[:, None], ranks[:, 1:], ranks[:, :-1])
                right = np.flatnonzero(at < ranks.shape[1])
                ranks[right, at[right]] = self.lookup(ids[right, at[right]], ids[right, at[right] + 1])
                left = np.flatnonzero(at > 0)
                ranks[left, at[left] - 1] = self.lookup(ids[left, at[left] - 1], ids[left, at[left]])
            else:
                ranks = ranks[:, :0]
        return out

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same merges for one long piece, over a heap of (rank, position)."""
        ids = [int(self.single[b]) for b in piece]
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        get, words = self.ranks.get, self.pieces
        rank = lambda i: get(words[ids[i]] + words[ids[after[i]]]) if after[i] < len(ids) else None
        heap = [(r, i) for i in range(len(ids)) if (r := rank(i)) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            if ids[i] < 0 or rank(i) != r:
                continue
            j = after[i]
            ids[i], ids[j], after[i] = r, -1, after[j]
            if after[j] < len(ids):
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and (n := rank(k)) is not None:
                    heapq.heappush(heap, (n, k))
        return np.array([x for x in ids if x >= 0], np.int32)

    def encode_pieces(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a piece that is itself in the vocabulary is one id."""
        out: list = [None] * len(pieces)
        todo = []
        for i, p in enumerate(pieces):
            r = self.ranks.get(p)
            if r is not None:
                out[i] = np.array([r], np.int32)
            elif len(p) > LONG:
                out[i] = self.merge_long(p)
            elif p:
                todo.append(i)
            else:
                out[i] = np.zeros(0, np.int32)
        todo.sort(key=lambda i: len(pieces[i]))
        start = 0
        while start < len(todo):
            low = len(pieces[todo[start]])
            rows = max(64, ROWS * 8 // low)
            stop = start + 1
            while stop < len(todo) and stop - start < rows and len(pieces[todo[stop]]) <= low + low // 4:
                stop += 1
            for i, ids in zip(todo[start:stop], self.merge_rows([pieces[i] for i in todo[start:stop]])):
                out[i] = ids
            start = stop
        return out


@lru_cache(maxsize=4)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Encoder:
    """Encodes texts, sharing the results of repeated pieces between batches."""

    def __init__(self, path: str, pattern: str):
        self.words = vocabulary(path)
        self.find = regex.compile(pattern).findall
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, offsets of each text)."""
        if len(self.index) > HELD:
            self._clear()
        cut = [self.find(t) for t in texts]
        fresh = list({p for c in cut for p in c} - self.index.keys())
        if fresh:
            got = self.words.encode_pieces([p.encode("utf-8") for p in fresh])
            base = len(self.index)
            self.index.update({p: base + i for i, p in enumerate(fresh)})
            self.flat = np.concatenate([self.flat, *got])
            ends = self.starts[-1] + np.cumsum([len(g) for g in got])
            self.starts = np.concatenate([self.starts, ends])
        which = np.fromiter((self.index[p] for c in cut for p in c), np.int64)
        lengths = np.diff(self.starts)[which]
        ends = np.cumsum(lengths)
        size = int(ends[-1]) if len(ends) else 0
        take = np.arange(size) + np.repeat(self.starts[which] - (ends - lengths), lengths)
        pieces = np.concatenate([[0], np.cumsum([len(c) for c in cut])]).astype(np.int64)
        offsets = np.concatenate([[0], ends])[pieces]
        return self.flat[take], offsets


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids of every row: the ids as little-endian unsigned 32-bit integers, in one binary.

    A null text counts as empty and has no ids; rows may repeat; an empty table gives an empty
    result. ``path`` must be readable on every executor, as an installed package's file is.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        coder = Encoder(path, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 2_000_000):
                ids, offsets = coder.encode(texts[i:j])
                held = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
                cuts = pa.py_buffer((offsets * 4).astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.Array.from_buffers(pa.binary(), j - i, [None, cuts, held])], ["doc_id", "ids"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, ids binary")


def decode(tokens: DataFrame, path: str) -> DataFrame:
    """doc_id, ids and the bytes they stand for. Null ids count as none."""
    small_batches(tokens.sparkSession)

    def run(batches):
        words = vocabulary(path).pieces
        for b in batches:
            ids = b.column(1).to_pylist()
            texts = [b"".join(map(words.__getitem__, np.frombuffer(x or b"", "<u4").tolist())) for x in ids]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.binary())], ["doc_id", "ids", "bytes"])

    return tokens.select("doc_id", "ids").mapInArrow(run, "doc_id long, ids binary, bytes binary")
