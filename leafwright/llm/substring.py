"""Removal of word runs that occur more than once anywhere, by relative Lempel-Ziv parsing.

`anchors` brings all occurrences of a repeated run together: per anchor, the distinct contexts are the reference
blocks. Each context is factored greedily against the blocks of all others: an index finds a block that continues with
the next `length` words, and the factor goes on as long as that block does. Runs that straddle two factors are checked
at the boundary: parsing goes on with the first window that the factor does not hold whole. Factors of `length` words
or more are duplicate spans, as is a context that occurs twice as a whole.

Defined results: a null text has no words; words are compared unchanged, by their bytes; repeated rows are copies of
each other; runs never cross documents but may repeat inside one; runs are judged on the input; an empty table gives
an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafwright.llm import anchors, flat

RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"


def factors(words: list[bytes], own: int, blocks: list[list[bytes]], index: dict[bytes, list[tuple[int, int]]], length: int) -> list[tuple[int, int, int, int]]:
    """(from, length, block, place) of each factor of at least `length` words."""
    out, t = [], 0
    while t + length <= len(words):
        other = next(((b, p) for b, p in index.get(b" ".join(words[t : t + length]), ()) if b != own), None)
        if other is None:
            t += 1
            continue
        block, place = blocks[other[0]], other[1]
        n = length
        while t + n < len(words) and place + n < len(block) and words[t + n] == block[place + n]:
            n += 1
        out.append((t, n, *other))
        t += n - length + 1
    return out


def resolve(texts: list[bytes], own: list[int], times: list[int], length: int) -> list[np.ndarray]:
    blocks = [t.split(b" ") for t in texts]
    index: dict[bytes, list[tuple[int, int]]] = {}
    for b, words in enumerate(blocks):
        for p in range(len(words) - length + 1):
            places = index.setdefault(b" ".join(words[p : p + length]), [])
            if len(places) < 2:  # any other block will do, and two hold one that is not the asker's own
                places.append((b, p))
    out = []
    for b, words in enumerate(blocks):
        bound = np.full(len(words) - length + 1, anchors.ALL if times[b] > 1 else anchors.NONE, np.int64)
        if times[b] < 2:
            for at, n, _, _ in factors(words, b, blocks, index, length):
                bound[at : at + n - length + 1] = anchors.ALL
        out.append(bound)
    return out


def _finish(rows: pa.Table, removed: dict, length: int, with_text: bool) -> pa.Table:
    out = []
    keys = [rows.column(c).to_pylist() for c in ("doc_id", "doc", "tie")]
    data, offsets = flat.text_bytes(rows.column("text"))
    for row, (doc_id, doc, tie) in enumerate(zip(*keys, strict=True)):
        words = data[offsets[row] : offsets[row + 1]].tobytes().split()
        spans = anchors.merged(removed.get((doc, tie), []), length)
        at, kept = 0, []
        for a, b in spans:
            kept += words[at:a]
            at = b
        kept += words[at:]
        left = b" ".join(kept)
        out.append((doc_id, len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
    columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])


def substring_dedup(docs: DataFrame, length: int = 35, k: int = 8, with_text: bool = True) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and, if wanted, the kept words joined by one space."""
    windows = anchors.Windows(length, k, words=True)
    return anchors.repeated(docs, windows, partial(resolve, length=length), partial(_finish, length=length, with_text=with_text), RESULT)
