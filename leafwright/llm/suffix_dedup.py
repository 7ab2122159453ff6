"""Exact removal of byte strings that a document with a smaller doc_id has too, by suffix sorting.

`anchors` brings all occurrences of a repeated string together. Per anchor, the distinct contexts are sorted by
`grouping_sort.suffix_array`; intervals of the suffix array in which neighbours share `length` bytes or more are one
string; each gets the smallest doc_id among its contexts, and documents above that lose it.

Defined results: a null text has no bytes; a null doc_id is larger than all others; documents with one doc_id take
nothing from each other; strings never cross documents; strings are judged on the input, not on what is left; an empty
table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from leafwright.llm import anchors
from leafwright.llm.grouping_sort import common_prefixes, suffix_array

RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"


def resolve(texts: list[bytes], least: list[int], times: list[int], length: int) -> list[np.ndarray]:
    """For each window of each context the smallest doc_id that has it."""
    joined, begin = [], []
    for k, t in enumerate(texts):
        begin.append(sum(map(len, joined[-1:])) + (begin[-1] if begin else 0))
        joined.append(np.append(np.frombuffer(t, np.uint8).astype(np.int64) + 1 + len(texts), 1 + k))
    text = np.append(np.concatenate(joined), 0)
    owner = np.repeat(np.arange(len(texts)), [len(x) for x in joined]).tolist() + [0]
    order = suffix_array(text)
    shared = common_prefixes(text.tolist(), order)
    bounds = [np.full(len(t) - length + 1, m, np.int64) for t, m in zip(texts, least, strict=True)]
    lo = 0
    for hi in range(1, len(order) + 1):
        if hi == len(order) or shared[hi] < length:
            if hi - lo > 1:
                first = min(least[owner[i]] for i in order[lo:hi])
                for i in order[lo:hi]:
                    bounds[owner[i]][i - begin[owner[i]]] = first
            lo = hi
    return bounds


def _finish(rows: pa.Table, removed: dict, length: int, with_text: bool) -> pa.Table:
    out = []
    docs = (rows.column(c).to_pylist() for c in ("doc_id", "doc", "tie", "text"))
    for doc_id, doc, tie, text in zip(*docs, strict=True):
        data = (text or "").encode()
        spans = anchors.merged(removed.get((doc, tie), []), length)
        at, kept = 0, []
        for a, b in spans:
            kept.append(data[at:a])
            at = b
        left = b"".join([*kept, data[at:]]) if spans else data
        out.append((doc_id, len(data), len(data) - len(left), len(spans), hashlib.sha256(left).hexdigest(), left if with_text else None))
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
    columns = list(zip(*out, strict=True)) or [[]] * len(kinds)
    return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def suffix_dedup(docs: DataFrame, length: int = 50, k: int = 16, with_text: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and, if wanted, the kept bytes."""
    windows = anchors.Windows(length, k, words=False)
    return anchors.repeated(docs, windows, partial(resolve, length=length), partial(_finish, length=length, with_text=with_text), RESULT)
