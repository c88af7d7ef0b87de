"""Token counts as a tokenizer library gives them, with overlap resynchronisation.

A huge text is encoded in overlapping chunks with offsets. Two neighbouring chunks are joined
at a common boundary that is proven stable: a place where both chunks start a token and where
the text goes from a visible character to one space and another visible character. A
byte-level pre-tokenizer always starts a new piece there, whatever lies before, and no special
string holds a space. Where the overlap holds no such place it is widened, at last to the
whole chunk. Shorter texts are cut at the same places, so each distinct piece is encoded once
per worker.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import id_text, slices, small_batches

#: Characters above which a text is encoded in chunks, a chunk's length, the first overlap.
HUGE, CHUNK, OVERLAP = 32_768, 16_384, 256
HELD = 300_000
STABLE = re.compile(r"(?<=\S)(?= \S)")
UNSURE = re.compile(r" \s|\s |^ | $")


@lru_cache(maxsize=4)
def library(path: str):
    """The tokenizer, if its pre-tokenizer has the boundaries proven above."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        kind = json.load(f)
    pre = kind.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    if not plain or kind.get("normalizer") or kind.get("post_processor") or kind.get("truncation") or kind.get("padding"):
        raise ValueError("only byte-level tokenizers without normaliser and added tokens have these stable boundaries")
    if any(" " in t["content"] or t.get("lstrip") or t.get("rstrip") or t.get("single_word") for t in kind.get("added_tokens", [])):
        raise ValueError("an added token may reach across a boundary")
    return Tokenizer.from_file(path)


def count_chunks(text: str, tokenizer, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
    """Tokens of a huge text from overlapping chunks."""
    def starts(a: int, b: int) -> list[int]:
        return [a + s for s, _ in tokenizer.encode(text[a:b], add_special_tokens=False).offsets]

    def stable(p: int) -> bool:
        return text[p] == " " and not text[p - 1].isspace() and not text[p + 1].isspace()

    n, total, left = len(text), 0, 0
    a, b = 0, min(n, chunk)
    now = starts(a, b)
    while b < n:
        wide = overlap
        while True:
            c = b - wide
            if c <= left:
                b = min(n, b + (b - a))
                now = starts(a, b)
                break
            d = min(n, b + chunk - overlap)
            following = starts(c, d)
            common = [p for p in set(now) & set(following) if c < p < b - 1 and p > left and stable(p)]
            if common:
                cut = max(common)
                total += sum(left <= s < cut for s in now)
                left, a, b, now = cut, c, d, following
                break
            wide *= 2
    return total + sum(s >= left for s in now)


class Counter:
    def __init__(self, path: str, huge: int = HUGE):
        self.tokenizer, self.huge, self.held = library(path), huge, {}

    def pieces(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return STABLE.split(text)
        first, *rest = text.split(" ")
        return [first, *[" " + x for x in rest]]

    def count(self, texts: list[str]) -> list[int]:
        if len(self.held) > HELD:
            self.held.clear()
        cut = [None if len(t) > self.huge else self.pieces(t) for t in texts]
        fresh = list({p for c in cut if c for p in c} - self.held.keys())
        for i in range(0, len(fresh), 20_000):
            part = fresh[i:i + 20_000]
            self.held.update(zip(part, map(len, self.tokenizer.encode_batch_fast(part, add_special_tokens=False))))
        get = self.held.__getitem__
        return [count_chunks(t, self.tokenizer) if c is None else sum(map(get, c)) for t, c in zip(texts, cut)]


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens and over_limit of every row.

    Special strings inside a text count as the library's default has them; nothing is added.
    A null text counts as empty: 0 bytes, 0 tokens. Rows may repeat; an empty table gives an
    empty result. ``path`` must be readable on every executor.
    """
    small_batches(docs.sparkSession)

    def run(batches):
        counter = Counter(path)
        for b in batches:
            texts = b.column(1).to_pylist()
            for i, j in slices(texts, 2_000_000):
                n = counter.count(texts[i:j])
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(i, j - i), pa.array([len(t.encode("utf-8")) for t in texts[i:j]], pa.int64()),
                     pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return id_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
