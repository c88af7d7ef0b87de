"""Quality rules: gradient-boosted trees over document statistics.

The trees are grown in numpy on a bounded sample of labelled documents, flattened into node
arrays and applied to whole batches: every row walks all trees at once. Chosen features carry
a monotonic constraint, so that more symbols, more repeated lines or more repeated words never
raise a document's score.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, slices, small_batches

#: Labelled rows the trees are grown on: those with the smallest seeded hash of their id.
TRAIN_ROWS = 20_000
#: A document goes when its probability of being good is below this.
KEEP_FROM = 0.5

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
DIGITS = b"0123456789"
UPPER = bytes(range(65, 91))
STOPS = b".,;:!?'\"()-"
#: (feature, direction): -1 means a larger value never raises the score.
FEATURES = (("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1), ("log_words", 0), ("word_length", 0),
            ("digit_share", 0), ("upper_share", 0), ("stop_share", 0), ("distinct_share", 0), ("words_per_line", 0), ("wide_share", 0))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeat_words(words: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    covered, upto = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered += i + 3 - max(i, upto)
            upto = i + 3
    return covered


def without(raw: bytes, chars: bytes) -> int:
    """How many of the bytes are in ``chars``."""
    return len(raw) - len(raw.translate(None, chars))


def statistics(text: str) -> tuple[tuple, tuple]:
    """(the counts of COUNTS, the values of FEATURES) of one text."""
    raw = text.encode("utf-8")
    words = raw.split()
    n = len(words)
    chars = len(text) - without(raw, WHITE)
    symbols = without(raw, SYMBOLS)
    lines = [x for x in raw.split(b"\n") if x.split(None, 1)]
    dups = len(lines) - len(set(lines))
    repeats = repeat_words(words)
    d = max(1, n)
    c = max(1, chars)
    values = (symbols / d, dups / max(1, len(lines)), repeats / d, np.log1p(n), chars / d, without(raw, DIGITS) / c,
              without(raw, UPPER) / c, without(raw, STOPS) / c, len(set(words)) / d, n / max(1, len(lines)),
              (len(raw) - len(text)) / max(1, len(raw)))
    return (n, chars, symbols, dups, repeats), values


@dataclass
class Trees:
    """Nodes of all trees in arrays; a leaf points at itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Log odds of being good for every row of x."""
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[rows, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return self.base + self.value[node].sum(1)


def grow(x: np.ndarray, y: np.ndarray, signs: tuple, rounds: int = 60, depth: int = 4, rate: float = 0.15,
         bins: int = 64, weight: float = 1.0, least: float = 5.0) -> Trees:
    """Boosted trees for P(y = 1) with logistic loss over binned features.

    signs: per feature -1, 0 or 1. A split on a constrained feature is taken only if its two
    values are ordered, and bounds halfway between them hold for all nodes below.
    """
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], 1)
    share = min(max(y.mean(), 1e-3), 1 - 1e-3)
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    feature, threshold, left, right, value, roots = [], [], [], [], [], []

    def add(v: float) -> int:
        i = len(value)
        feature.append(0)
        threshold.append(np.inf)
        left.append(i)
        right.append(i)
        value.append(v)
        return i

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        roots.append(add(0.0))
        level = [(roots[-1], np.arange(len(y)), -np.inf, np.inf)]
        for d in range(depth + 1):
            below = []
            for node, rows, low, high in level:
                gs, hs = g[rows].sum(), h[rows].sum()
                own = float(np.clip(-gs / (hs + weight), low, high))
                best = None
                for j in range(x.shape[1] if d < depth else 0):
                    b, size = binned[rows, j], len(cuts[j]) + 1
                    gl, hl = np.cumsum(np.bincount(b, g[rows], size))[:-1], np.cumsum(np.bincount(b, h[rows], size))[:-1]
                    if not len(gl):
                        continue
                    gr, hr = gs - gl, hs - hl
                    wl, wr = np.clip(-gl / (hl + weight), low, high), np.clip(-gr / (hr + weight), low, high)
                    gain = -(gl * wl + (hl + weight) * wl**2 / 2 + gr * wr + (hr + weight) * wr**2 / 2) + gs * own + (hs + weight) * own**2 / 2
                    gain[(hl < least) | (hr < least)] = -1
                    if signs[j]:
                        gain[signs[j] * (wr - wl) < 0] = -1
                    k = int(gain.argmax())
                    if gain[k] > 1e-6 and (best is None or gain[k] > best[0]):
                        best = gain[k], j, k, float(wl[k]), float(wr[k])
                if best is None:
                    value[node] = rate * own
                    total[rows] += value[node]
                    continue
                _, j, k, wl, wr = best
                feature[node], threshold[node] = j, float(cuts[j][k])
                side = binned[rows, j] <= k
                middle = (wl + wr) / 2
                bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}[signs[j]]
                left[node], right[node] = add(0.0), add(0.0)
                below += [(left[node], rows[side], *bounds[0]), (right[node], rows[~side], *bounds[1])]
            level = below
    return Trees(np.array(feature), np.array(threshold), np.array(left), np.array(right), np.array(value), np.array(roots), depth, base)


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, most: int) -> DataFrame:
    """Statistics and label of at most ``most`` labelled rows; ``most`` also bounds the broadcast."""
    chosen = (labels.where("quality IS NOT NULL AND doc_id IS NOT NULL")
              .select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("good"))
              .orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id", "good").limit(most))
    rows = id_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "good")

    def run(batches):
        for b in batches:
            x = [statistics(t)[1] for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "good", "x"])

    return rows.mapInArrow(run, "doc_id long, good double, x array<double>")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = TRAIN_ROWS) -> Trees | None:
    """Trees from the labelled sample; None if it lacks good or bad rows."""
    small_batches(docs.sparkSession)
    rows = sorted(tuple(r) for r in training_rows(docs, labels, id_col, text_col, most).collect())
    y = np.array([r[1] for r in rows])
    if len(y) < 2 or y.min() == y.max():
        return None
    return grow(np.array([r[2] for r in rows]), y, tuple(s for _, s in FEATURES))


def judge(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, the counts, base_failed, kept and probability of every row.

    base_failed: under 50 words, or over half of the words in repeated three-word windows.
    Without trees (no usable labels) every document that passes the base rules is kept, and its
    probability is null. A null text counts as empty and fails; rows that repeat are judged
    alike; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    cut = float(np.log(keep_from / (1 - keep_from)))

    def run(batches):
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts):
                both = [statistics(t) for t in texts[i:j]]
                n = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
                failed = (n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0])
                if trees is None:
                    kept, chance = ~failed, pa.nulls(j - i, pa.float64())
                else:
                    odds = trees.score(np.array([x for _, x in both]).reshape(-1, len(FEATURES)))
                    kept, chance = ~failed & (odds >= cut), pa.array(1 / (1 + np.exp(-odds)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *[pa.array(n[:, k]) for k in range(len(COUNTS))],
                                                  pa.array(failed), pa.array(kept), chance],
                                                 ["doc_id", *COUNTS, "base_failed", "kept", "probability"])

    return id_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, probability double")


def keep_good(docs: DataFrame, trees: Trees | None, keep_from: float = KEEP_FROM, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns; no shuffle."""
    small_batches(docs.sparkSession)
    cut = float(np.log(keep_from / (1 - keep_from)))
    at = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            texts = [t or "" for t in b.column(at).to_pylist()]
            both = [statistics(t) for t in texts]
            n = np.array([c for c, _ in both], np.int64).reshape(-1, len(COUNTS))
            kept = ~((n[:, 0] < 50) | (100 * n[:, 4] > 50 * n[:, 0]))
            if trees is not None:
                kept &= trees.score(np.array([x for _, x in both]).reshape(-1, len(FEATURES))) >= cut
            yield b.filter(pa.array(kept))

    return docs.mapInArrow(run, docs.schema)
