"""Shared passages of fixed length between documents of any number and size.

A unit is a byte or a word; a window is `length` consecutive units of one text. The smallest `k`-gram hash inside a
window is its anchor: equal windows have equal anchors at equal places. So all copies of a window meet where their
anchor's hash is dealt to, and what has no partner leaves early. Documents are dealt into groups by hash; four steps:

1. `_announce`: a row (anchor hash, group) for each group of documents that has it, counted; hashes that occur twice go on.
2. `_contexts`: in those groups, the text around each such anchor: all units of the windows that it is the anchor of.
   One row for each distinct context of a group, and one row for the group with the places of all of them.
3. `resolve` (the operator's own method): within one anchor's distinct contexts, which windows are repeats.
4. the last step: each group looks up its contexts and gives each text its repeated windows.

Every row count above grows with the input alone, and an anchor that a third of all texts share is one row a group, not
one an occurrence. Groups and buckets follow from hashes, their number from the size of the input.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm import flat
from leafwright.llm.runtime import MOST_PARTITIONS, dropped, groups_for, stored

#: Bytes of text that one pass of array operations takes, and for which anchors are counted before they are sent.
PASS_BYTES, PACK_BYTES = 1 << 19, 32 << 20
#: Window starts of a long text that one pass takes.
STRETCH = 1 << 19
_CODEC = "zstd"


def packed(value: object) -> bytes:
    raw = pickle.dumps(value, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, _CODEC, asbytes=True)


def unpacked(data: bytes) -> object:
    return pickle.loads(pa.decompress(data[8:], int.from_bytes(data[:8], "little"), _CODEC, asbytes=True))


@dataclass(frozen=True)
class Windows:
    length: int
    k: int
    words: bool

    def units(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text to cut contexts from, unit starts and ends in it, unit hashes, offsets of texts in units."""
        if not self.words:
            at = np.arange(len(data) + 1)
            return data, at[:-1], at[1:], flat.BYTE_HASH[data], offsets
        starts, ends, texts = flat.words_of(data, offsets)
        return data, starts, ends, flat.word_hash(data, starts, ends), texts

    def anchors(self, hashes: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """text, anchor hash, first and last window start (in units of all texts) of each run of windows with one anchor."""
        w = self.length - self.k + 1
        for a, b in self._stretches(offsets):
            x = hashes[a:b]
            if len(x) < self.length:
                continue
            h = flat.gram_hash(x, self.k)
            key = (h >> np.uint64(24) << np.uint64(24)) | np.arange(len(h), dtype=np.uint64)
            least = flat.sliding_min(key, w) & np.uint64((1 << 24) - 1)
            t0, t1 = np.searchsorted(offsets, a, side="right") - 1, np.searchsorted(offsets, b, side="left")
            bounds = np.clip(offsets[t0 : t1 + 1], a, b) - a
            valid = np.zeros(len(least) + 1, dtype=np.int32)
            lo = np.minimum(bounds[:-1], len(least))
            hi = np.maximum(np.minimum(bounds[1:] - self.length + 1, len(least)), lo)
            np.add.at(valid, lo, 1)
            np.add.at(valid, hi, -1)
            at = np.flatnonzero(np.cumsum(valid[:-1]) > 0)
            if not len(at):
                continue
            p = least[at].astype(np.int64)
            new = np.concatenate([[True], (p[1:] != p[:-1]) | (at[1:] != at[:-1] + 1)])
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at)) - 1
            first, last = at[head] + a, at[tail] + a
            yield np.searchsorted(offsets, first, side="right") - 1, h[p[head]], first, last

    def _stretches(self, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of units for one pass; those of a text that is too long overlap so that no window is cut."""
        for a, b in flat.cuts(np.diff(offsets), STRETCH):
            lo, hi = int(offsets[a]), int(offsets[b])
            while hi - lo > 2 * STRETCH:
                yield lo, lo + STRETCH + self.length - 1
                lo += STRETCH
            yield lo, hi


def _passes(batch: pa.RecordBatch | pa.Table, windows: Windows, column: str = "text") -> Iterator[tuple]:
    """first row, then what Windows.units gives, for stretches of rows."""
    texts = batch.column(column)
    data, offsets = flat.text_bytes(texts)
    for a, b in flat.cuts(np.diff(offsets), PASS_BYTES):
        yield a, *windows.units(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


def _announce(keyed: DataFrame, windows: Windows, parts: int) -> DataFrame:
    """h, g: the anchor hashes that occur more than once, by the groups that have them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def rows() -> pa.RecordBatch:
            h, g = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            held.clear()
            order = np.lexsort((g, h))
            h, g = h[order], g[order]
            first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (g[1:] != g[:-1])]))
            n = np.diff(np.append(first, len(h)))
            return pa.RecordBatch.from_arrays([pa.array(h[first].view(np.int64)), pa.array(g[first]), pa.array(np.minimum(n, 2).astype(np.int8))], ["h", "g", "n"])

        for batch in batches:
            groups = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, _, _, hashes, offsets in _passes(batch, windows):
                for text, h, _, _ in windows.anchors(hashes, offsets):
                    if windows.words:
                        held.append((h, groups[text + row]))
                    else:  # once a text
                        order = np.lexsort((h, text))
                        once = np.concatenate([[True], (np.diff(text[order]) != 0) | (h[order][1:] != h[order][:-1])])
                        held.append((h[order][once], groups[text[order][once] + row]))
                size += len(data)
                if size > PACK_BYTES and held:
                    yield rows()
                    size = 0
        if held:
            yield rows()

    sent = keyed.select("g", "text").mapInArrow(run, "h long, g long, n byte").repartition(parts, "h")
    times = F.sum("n").over(Window.partitionBy("h"))
    return sent.withColumn("times", times).where("times > 1").select("h", "g")


#: Rows of `_contexts`: a context of a group (id from 0), or with id -1 the places of all its contexts.
CONTEXT = "g long, id int, h long, text binary, least long, times int, places binary"


def _contexts(keyed: DataFrame, wanted: DataFrame, windows: Windows, parts: int) -> DataFrame:
    """The distinct contexts of each group with the smallest document and the number of their occurrences, and packed:
    context, doc, tie and first unit of each occurrence."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        columns: list[list] = [[] for _ in range(7)]
        if docs.num_rows and answers.num_rows:
            want = np.unique(answers.column("h").to_numpy().view(np.uint64))
            group = docs.column("g")[0].as_py()
            ids, ties = (docs.column(c).to_numpy() for c in ("doc", "tie"))
            known: dict[bytes, int] = {}
            anchor: list[np.ndarray] = []
            which, place = [], []
            for row, data, starts, ends, hashes, offsets in _passes(docs, windows):
                raw = data.tobytes()
                if windows.words:
                    raw = raw.translate(bytes(0x20 if flat.IS_SPACE[i] else i for i in range(256)))
                for text, h, first, last in windows.anchors(hashes, offsets):
                    hit = want[np.minimum(np.searchsorted(want, h), len(want) - 1)] == h
                    text, h, first, last = text[hit], h[hit], first[hit], last[hit]
                    begin, until = starts[first].tolist(), ends[last + windows.length - 1].tolist()
                    cut = [raw[a:b] for a, b in zip(begin, until, strict=True)]
                    if windows.words:
                        cut = [b" ".join(c.split()) if b"  " in c else c for c in cut]
                    at = np.array([known.setdefault(c, len(known)) for c in cut], dtype=np.int64)
                    fresh = np.unique(at, return_index=True)
                    new = fresh[0] >= sum(map(len, anchor))
                    anchor.append(h[fresh[1][new]])
                    which.append(at)
                    place.append((text + row, first - offsets[text]))
            if known:
                n, at = len(known), np.concatenate(which)
                row, start = (np.concatenate([p[i] for p in place]) for i in (0, 1))
                least = np.full(n, NONE, np.int64)
                np.minimum.at(least, at, ids[row])
                places = packed((at.astype(np.uint32), ids[row], ties[row], start))
                nobody = [None]
                columns = [
                    [group] * (n + 1), [*range(n), -1], [*np.concatenate(anchor).view(np.int64).tolist(), None], [*known, None],
                    [*least.tolist(), None], [*np.minimum(np.bincount(at, minlength=n), 2).tolist(), None], nobody * n + [places],
                ]
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["g", "id", "h", "text", "least", "times", "places"])

    return keyed.repartition(parts, "g").groupBy("g").cogroup(wanted.repartition(parts, "g").groupBy("g")).applyInArrow(run, CONTEXT)


#: For each context of one anchor a bound by window: the window is removed from documents above its bound.
Resolver = Callable[[list[bytes], list[int], list[int]], list[np.ndarray]]
NONE, ALL = (1 << 63) - 1, -(1 << 63)


def _resolved(contexts: DataFrame, windows: Windows, resolve: Resolver, buckets: int, parts: int) -> DataFrame:
    """g, id, from, until, bound: of a group's context, the windows from and up to until are removed from documents
    above the bound. Bounds that remove nothing are left out."""

    def run(rows: pa.Table) -> pa.Table:
        group, id_, own, many = (rows.column(c).to_numpy() for c in ("g", "id", "least", "times"))
        known: dict[bytes, int] = {}
        of = np.array([known.setdefault(t, len(known)) for t in rows.column("text").to_pylist()], dtype=np.int64)
        texts = list(known)
        anchors = np.zeros(len(texts), np.uint64)
        anchors[of] = rows.column("h").to_numpy().view(np.uint64)
        least, times = np.full(len(texts), NONE, np.int64), np.zeros(len(texts), np.int64)
        np.minimum.at(least, of, own)
        np.add.at(times, of, many)
        own, special = _bounds(texts, anchors, least, times, windows, resolve)
        count = _window_counts(texts, windows)
        plain = (times > 1) & (own < NONE)  # what occurs once as a whole loses nothing as a whole
        plain[list(special)] = False
        whole = np.flatnonzero(plain)
        of_text, first, until, bound = [whole], [np.zeros(len(whole), np.int64)], [count[whole]], [own[whole]]
        for k, b in special.items():
            at = np.append(0, np.flatnonzero(np.diff(b)) + 1)
            some = b[at] < NONE
            of_text.append(np.full(int(some.sum()), k))
            first.append(at[some])
            until.append(np.append(at[1:], count[k])[some])
            bound.append(b[at][some])
        of_text, first, until, bound = map(np.concatenate, (of_text, first, until, bound))
        order = np.argsort(of_text, kind="stable")
        first, until, bound = first[order], until[order], bound[order]
        n = np.bincount(of_text, minlength=len(texts))
        begin = np.cumsum(n) - n
        row = np.repeat(np.arange(len(of)), n[of])
        at = np.arange(len(row)) - np.repeat(np.cumsum(n[of]) - n[of], n[of]) + begin[of[row]]
        return pa.table({"g": group[row], "id": id_[row], "from": first[at], "until": until[at], "bound": bound[at]})

    dealt = contexts.where("id >= 0").select("g", "id", "h", "text", "least", "times", F.pmod("h", F.lit(buckets)).alias("bucket"))
    return dealt.repartition(parts, "bucket").groupBy("bucket").applyInArrow(run, "g long, id int, from long, until long, bound long")


def _window_counts(texts: list[bytes], windows: Windows) -> np.ndarray:
    units = [t.count(b" ") + 1 for t in texts] if windows.words else [len(t) for t in texts]
    return np.array(units, dtype=np.int64) - windows.length + 1


def _bounds(texts: list[bytes], anchors: np.ndarray, least: np.ndarray, times: np.ndarray, windows: Windows, resolve: Resolver) -> tuple[np.ndarray, dict[int, np.ndarray]]:
    """Each context's bound as a whole, and by context the bounds of its windows where those are not the same. Only
    contexts of an anchor that share a window (by hash, a superset of what the exact method finds) with another context
    are given to that method."""
    own = least if not windows.words else np.where(times > 1, ALL, NONE)
    bounds: dict[int, np.ndarray] = {}
    order = np.argsort(anchors, kind="stable")
    a = anchors[order]
    crowd = np.zeros(len(a), dtype=bool)
    crowd[1:] = a[1:] == a[:-1]
    crowd[:-1] |= crowd[1:].copy()
    several = np.sort(order[crowd])
    if not len(several):
        return own, bounds
    sharing: list[np.ndarray] = []
    keys: list[np.ndarray] = []
    nth: list[np.ndarray] = []
    sizes = np.array([len(texts[i]) for i in several.tolist()])
    for lo, hi in flat.cuts(sizes, PASS_BYTES):
        part = [texts[i] for i in several[lo:hi].tolist()]
        raw = np.frombuffer(b"".join(part), np.uint8)
        offsets = np.concatenate([[0], np.cumsum(sizes[lo:hi])])
        _, _, _, hashes, unit = windows.units(raw, offsets)
        h = flat.gram_hash(hashes, windows.length)
        n = np.maximum(np.diff(unit) - windows.length + 1, 0)
        at = np.repeat(unit[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        keys.append(h[at])
        sharing.append(np.repeat(several[lo:hi], n))
        nth.append(at - np.repeat(unit[:-1], n))
    key, who, window = np.concatenate(keys), np.concatenate(sharing), np.concatenate(nth)
    order = np.argsort(key, kind="stable")
    key, who, window = key[order], who[order], window[order]
    twice = np.zeros(len(key), dtype=bool)
    twice[1:] = key[1:] == key[:-1]
    twice[:-1] |= twice[1:].copy()
    found = np.unique(who[twice])
    found = found[np.argsort(anchors[found], kind="stable")]
    edge = np.flatnonzero(np.concatenate([[True], anchors[found][1:] != anchors[found][:-1], [True]])) if len(found) else []
    counts = _window_counts(texts, windows)
    first, last = np.zeros(len(texts), np.int64), counts - 1
    if not windows.words:  # bytes outside the shared windows need no sorting
        first[found], last[found] = counts[found], -1
        np.minimum.at(first, who[twice], window[twice])
        np.maximum.at(last, who[twice], window[twice])
    for lo, hi in zip(edge, edge[1:], strict=False):
        mine = found[lo:hi].tolist()
        cut = [texts[i] if windows.words else texts[i][first[i] : last[i] + windows.length] for i in mine]
        for i, b in zip(mine, resolve(cut, [int(own[i]) for i in mine], [int(times[i]) for i in mine]), strict=True):
            bounds[i] = np.full(counts[i], own[i], np.int64)
            bounds[i][first[i] : last[i] + 1] = b
    return own, bounds


def repeated(docs: DataFrame, windows: Windows, resolve: Resolver, finish: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """finish(rows, removed) makes the result of a group of documents; removed: window starts, first and last, by
    (doc_id, tie). rows has doc_id, tie, doc (doc_id with null as the largest) and text."""
    groups = groups_for(docs)
    parts = min(groups, MOST_PARTITIONS)  # of every shuffle, so that no task grows with the input
    keyed = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumns({"tie": F.xxhash64("text"), "doc": F.coalesce("doc_id", F.lit(NONE))})
    keyed = keyed.withColumn("g", F.pmod(F.xxhash64("doc", "tie"), F.lit(groups)))
    wanted = stored(_announce(keyed, windows, parts))
    contexts = stored(_contexts(keyed.select("g", "doc", "tie", "text"), wanted, windows, parts))
    dropped(wanted)
    bounds = stored(_resolved(contexts, windows, resolve, groups, parts))
    nothing = F.lit(None)
    places = contexts.where("id = -1").select("g", nothing.cast("int").alias("id"), nothing.cast("long").alias("from"), nothing.cast("long").alias("until"), nothing.cast("long").alias("bound"), "places")
    found = places.unionByName(bounds.withColumn("places", nothing.cast("binary")))

    def last(rows: pa.Table, found: pa.Table) -> pa.Table:
        removed: dict[tuple[int, int], list] = {}
        blobs = found.column("places").drop_null()
        if rows.num_rows and len(blobs):
            of, doc, tie, start = unpacked(blobs[0].as_py())
            of = of.astype(np.int64)
            known = found.filter(found.column("id").is_valid())
            id_, first, until, bound = (known.column(c).to_numpy() for c in ("id", "from", "until", "bound"))
            order = np.argsort(id_, kind="stable")
            id_, first, until, bound = id_[order], first[order], until[order], bound[order]
            lo, hi = np.searchsorted(id_, of), np.searchsorted(id_, of, side="right")
            n = hi - lo
            at = np.repeat(np.arange(len(of)), n)
            rule = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n) + lo[at]
            hit = bound[rule] < doc[at]
            at, rule = at[hit], rule[hit]
            for d, t, a, b in zip(doc[at].tolist(), tie[at].tolist(), (start[at] + first[rule]).tolist(), (start[at] + until[rule] - 1).tolist(), strict=True):
                removed.setdefault((d, t), []).append((a, b))
        return finish(rows, removed)

    return keyed.repartition(parts, "g").groupBy("g").cogroup(found.repartition(parts, "g").groupBy("g")).applyInArrow(last, schema)


def merged(windows: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of units, as (from, until), that windows with these first and last starts cover."""
    out: list[list[int]] = []
    for a, b in sorted(windows):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b + length)
        else:
            out.append([a, b + length])
    return [(a, b) for a, b in out]
