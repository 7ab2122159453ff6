"""Near-duplicate documents by DartMinHash signatures and banded joining.

Elements are word shingles; an element of weight w owns the region [0, w) x time. Hashed darts fall into unit cells of
that plane at random: a cell's dart count, and each dart's time, height and coordinate, follow from the element's hash
alone. A dart counts for a document if it falls below the element's weight. Per coordinate the earliest dart is the
signature, so two documents agree in a coordinate with the probability of their weighted Jaccard similarity. Only
times up to a bound that shrinks with the document's total weight are thrown; a document that leaves a coordinate empty
is thrown again with the bound doubled.

Documents with the same words are one class. Classes that share a band key are compared by their signatures, which leaves
a spanning forest of likely links: a few per class, never all pairs. Exact similarity is then decided along the edges of
that forest. Whatever shares a likely tree but is not joined up by true links so far is compared exactly, each class with
those of other components only.

A bucket or tree of many classes is cut into blocks. Its classes live in one block each; only those outside its largest
component also visit the other blocks, so a large group of near copies, which one component holds, is never multiplied.
A group of many classes that stay apart although they share a band or a likely tree is compared pair by pair, as exact
results need. A link of similarity 0.8 shares a band with probability 1 - 5e-8; its estimate falls below `likely` with
probability 1e-6.

Weights are 1 for each distinct shingle ("set": plain Jaccard) or its number of occurrences ("count").

Defined results: a text of fewer words than a shingle is one shingle; a text without words (null too) links with
nothing; every row is a document, whatever its doc_id, and rows with one doc_id and one text get one answer; a null
doc_id is larger than all others, and stays null where its component has no other; texts of any length are read whole; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafwright.llm import flat
from leafwright.llm.components import components
from leafwright.llm.runtime import dropped, looked_up, partitions_for, stored

#: Width of the first time band; each next one doubles the time.
FIRST_BAND = 1 / 16
PASS_BYTES = 1 << 19
SKETCH = "doc long, tie long, f1 long, f2 long, bands array<long>, marks binary"
_LAST = (1 << 63) - 1


def _unit(h: np.ndarray, shift: int = 11) -> np.ndarray:
    return (h >> np.uint64(shift)).astype(np.float64) * 2.0**-53


def _poisson_steps(mean: float) -> np.ndarray:
    """Distribution function of a Poisson variable, up to where it is 1."""
    p, out, total, n = np.exp(-mean), [], 0.0, 0
    while total < 1 - 1e-16 and n < 12 * mean + 40:
        total += p
        out.append(min(total, 1.0))
        n += 1
        p *= mean / n
    return np.array(out)


def dart_minhash(elements: np.ndarray, weights: np.ndarray | None, document: np.ndarray, documents: int, k: int) -> np.ndarray:
    """Earliest dart times, documents x k. weights None: 1 each, and repeats of an element in a document change nothing."""
    total = np.bincount(document, weights=weights, minlength=documents)
    bound = np.where(total > 0, k * (np.log(k) + 4) / np.maximum(total, 1e-300), 0.0)
    out = np.full((documents, k), np.inf)
    todo = total > 0
    while todo.any():
        out[todo] = np.inf
        mine = todo[document]
        best = out.ravel()
        e, d = elements[mine], document[mine]
        w = None if weights is None else weights[mine]
        cell = 0
        while len(e):
            low, high, band = 0.0, FIRST_BAND, 0
            f, g, v = e, d, w
            while len(f):
                with np.errstate(over="ignore"):
                    seed = flat.mixed(f ^ np.uint64((cell * 64 + band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
                n = np.searchsorted(_poisson_steps(high - low), _unit(seed), side="right")
                which = np.repeat(np.arange(len(f)), n)
                nth = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                with np.errstate(over="ignore"):
                    h = flat.mixed(seed[which] + (nth.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
                    time = low + (high - low) * _unit(h)
                    h = flat.mixed(h + np.uint64(0x632BE59BD9B4E019))
                ok = time < bound[g[which]]
                if v is not None:
                    ok &= cell + _unit(h) < v[which]
                coordinate = (flat.mixed(h) % np.uint64(k)).astype(np.int64)
                np.minimum.at(best, (g[which] * k + coordinate)[ok], time[ok])
                low, high, band = high, 2 * high, band + 1
                more = bound[g] > low
                f, g, v = f[more], g[more], None if v is None else v[more]
            cell += 1
            more = np.zeros(len(e), dtype=bool) if w is None else w > cell
            e, d, w = e[more], d[more], None if w is None else w[more]
        todo = todo & np.isinf(out).any(axis=1)
        bound = np.where(todo, 2 * bound, bound)
    return out


def shingles(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and texts of all shingles, and of all words."""
    starts, ends, at = flat.words_of(data, offsets)
    h = flat.word_hash(data, starts, ends)
    n = np.diff(at)
    text = np.repeat(np.arange(len(n)), n)
    grams = flat.gram_hash(h, words)
    count = np.maximum(n - words + 1, 0)
    where = np.repeat(at[:-1] - (np.cumsum(count) - count), count) + np.arange(count.sum())
    out, of = grams[where], np.repeat(np.arange(len(n)), count)
    for short in np.flatnonzero((n > 0) & (n < words)).tolist():
        with np.errstate(over="ignore"):
            out = np.append(out, flat.gram_hash(h[at[short] : at[short + 1]], int(n[short]))[:1] + np.uint64(n[short]))
        of = np.append(of, short)
    return out, of, h, text


def _counted(grams: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((grams, of))
    grams, of = grams[order], of[order]
    first = np.flatnonzero(np.concatenate([[True], (grams[1:] != grams[:-1]) | (of[1:] != of[:-1])])) if len(grams) else np.zeros(0, np.int64)
    return grams[first], of[first], np.diff(np.append(first, len(grams)))


def _fingerprints(h: np.ndarray, text: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each text's word sequence."""
    nth = np.arange(len(h)) - np.searchsorted(text, text)
    out = []
    with np.errstate(over="ignore"):
        for salt in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F):
            x = flat.mixed(h ^ flat.mixed(nth.astype(np.uint64) * np.uint64(salt) + np.uint64(1)))
            total = np.zeros(n + 1, np.uint64)
            total[1:] = 0
            run = np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)])
            edge = np.searchsorted(text, np.arange(n + 1))
            out.append((run[edge[1:]] - run[edge[:-1]]).view(np.int64))
    return out[0], out[1]


def _identity(docs: DataFrame) -> DataFrame:
    """doc (doc_id, null as the largest), tie and text of every row."""
    text = F.col("text").cast("string")
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def sketch(docs: DataFrame, words: int = 5, bands: int = 32, rows: int = 4, weight: str = "set") -> DataFrame:
    """doc, tie, fingerprint, band keys and one byte of each coordinate of every row; no fingerprint without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(1, bands + 1, dtype=np.uint64) << np.uint64(56)
        for batch in batches:
            data, offsets = flat.text_bytes(batch.column(2))
            for a, b in flat.cuts(np.diff(offsets), PASS_BYTES):
                n = b - a
                grams, of, h, text = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                f1, f2 = _fingerprints(h, text, n)
                counts = None
                if weight == "count":
                    grams, of, counts = _counted(grams, of)
                signature = flat.mixed(dart_minhash(grams, counts, of, n, bands * rows).view(np.uint64))
                key = np.zeros((n, bands), np.uint64)
                with np.errstate(over="ignore"):
                    for r in range(rows):
                        key = flat.mixed(key * np.uint64(0x9E3779B97F4A7C15) + signature.reshape(n, bands, rows)[:, :, r])
                    key = flat.mixed(key ^ salt)
                none = np.bincount(of, minlength=n) == 0
                at = np.flatnonzero(~none)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~none) * bands]).astype(np.int32)), pa.array(key[at].ravel().view(np.int64)))
                marks = (signature >> np.uint64(56)).astype(np.uint8)
                columns = [batch.column(0).slice(a, n), batch.column(1).slice(a, n), pa.array(f1, mask=none), pa.array(f2, mask=none), keys, pa.array([m.tobytes() for m in marks], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "tie", "f1", "f2", "bands", "marks"])

    return _identity(docs).mapInArrow(run, SKETCH)


def _parts(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """Batches that are sorted by keys, cut where a key changes; whether a part begins another group than the one before."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, dtype=bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        at = [0, *np.flatnonzero(new).tolist(), batch.num_rows]
        for lo, hi in zip(at, at[1:], strict=False):
            now = tuple(c[lo] for c in cols)
            yield now != last, batch.slice(lo, hi - lo)
            last = now


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups out of batches that are sorted by keys."""
    held: list[pa.RecordBatch] = []
    for new, part in _parts(batches, keys):
        if new and held:
            yield pa.Table.from_batches(held)
            held = []
        held.append(part)
    if held:
        yield pa.Table.from_batches(held)


def _block(n: str, size: int) -> Column:
    """The block, of about `size` rows, that a class lives in among n."""
    return F.pmod(F.xxhash64("rep", F.lit(7)), F.ceil(F.col(n) / size).cast("int")).cast("int")


def _meetings(rows: DataFrame, key: str, size: int, total: int) -> DataFrame:
    """key, block, visits, rep, component: of the keys whose classes are in several components, each class in the
    block that it lives in, and those outside the key's largest component as visitors to all blocks. rows: key, rep,
    component."""
    each = rows.groupBy(key, "component").agg(F.count(F.lit(1)).alias("n"))
    apart = each.groupBy(key).agg(F.sum("n").alias("n"), F.max_by("component", F.struct("n", "component")).alias("base"), F.count(F.lit(1)).alias("trees")).where("trees > 1")
    keys = stored(apart.select(F.col(key).alias("k"), "n", F.col("n").alias("all"), "base"))
    met = looked_up(rows, [key], keys, ["k"], "n", total, ["rep"])
    lives = met.select(key, _block("all", size).alias("block"), F.lit(0).alias("visits"), "rep", "component")
    blocks = F.explode(F.sequence(F.lit(0), F.ceil(F.col("all") / size).cast("int") - 1))
    visits = met.where("component <> base").select(key, blocks.alias("block"), F.lit(1).alias("visits"), "rep", "component")
    out = stored(lives.unionByName(visits))
    dropped(keys)
    return out


def _compared(met: DataFrame, key: str, data: str, alike: Callable[[list[bytes], bytes], np.ndarray]) -> DataFrame:
    """Links (a, b) between classes of different components of a block that are alike: of each visitor with one class
    of every component that it is not yet joined up with. met: _meetings with a column of data."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reps, tree, held = np.zeros(0, np.int64), np.zeros(0, np.int64), []
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            while parent.setdefault(x, x) != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for new, part in _parts(batches, [key, "block"]):
            if new:
                reps, tree, held, parent = np.zeros(0, np.int64), np.zeros(0, np.int64), [], {}
            visits = part.column("visits").to_numpy().astype(bool)
            rep, component = part.column("rep").to_numpy(), part.column("component").to_numpy()
            values = part.column(data)
            live = np.flatnonzero(~visits)
            reps, tree = np.concatenate([reps, rep[live]]), np.concatenate([tree, component[live]])
            held += [values[i].as_py() for i in live.tolist()]
            a, b = [], []
            for v in np.flatnonzero(visits).tolist():
                mine = root(int(component[v]))
                roots = np.array([root(x) for x in tree.tolist()], np.int64)
                other = np.flatnonzero(roots != mine)
                if not len(other):
                    continue
                near = other[alike([held[i] for i in other.tolist()], values[v].as_py())]
                for t, first in zip(*np.unique(roots[near], return_index=True), strict=True):
                    parent[int(t)] = mine
                    a.append(int(rep[v]))
                    b.append(int(reps[near[first]]))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    dealt = met.repartition(key, "block").sortWithinPartitions(key, "block", "visits")
    return dealt.select(key, "block", "visits", "rep", "component", data).mapInArrow(run, "a long, b long")


def _with_component(rows: DataFrame, joined: DataFrame) -> DataFrame:
    return rows.join(joined, F.col("rep") == F.col("id"), "left").select(*rows.columns, F.coalesce("component", "rep").alias("component"))


def likely_links(heads: DataFrame, likely: float, block: int = 1024) -> DataFrame:
    """Links that join up the same classes as all pairs of a band bucket whose signatures agree in `likely` of all
    coordinates or more. heads: rep, bands, marks. The result is a stored table."""
    keyed = heads.select("rep", F.explode("bands").alias("key"))
    keys = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("key").alias("k"), "n", F.col("n").alias("all")))
    total, largest = keys.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0))).first()
    mine = stored(looked_up(keyed, ["key"], keys, ["k"], "n", total, ["rep"]))
    dropped(keys)
    marked = heads.select(F.col("rep").alias("r"), "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _groups(batches, ["key", "block"]):
            rep = table.column("rep").to_numpy()
            marks = np.frombuffer(b"".join(table.column("marks").to_pylist()), np.uint8).reshape(len(rep), -1)
            a, b, left = [], [], np.arange(len(rep))
            while len(left) > 1:  # grow one tree from the first vertex left, then go on with the rest
                front, left = left[:1], left[1:]
                while len(front) and len(left):
                    v, front = front[0], front[1:]
                    near = (marks[left] == marks[v]).mean(axis=1) >= likely
                    a.append(rep[left[near]])
                    b.append(np.full(int(near.sum()), rep[v]))
                    front, left = np.append(front, left[near]), left[~near]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    met = mine.select("key", _block("all", block).alias("block"), "rep").join(marked, F.col("rep") == F.col("r")).select("key", "block", "rep", "marks")
    inside = met.repartition("key", "block").sortWithinPartitions("key", "block").mapInArrow(run, "a long, b long")
    found = stored(inside.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if largest > block:  # classes of one bucket in several blocks have not met yet
        joined = components(found)
        apart = _meetings(_with_component(mine.where(F.col("all") > block).select("key", "rep"), joined), "key", block, total)

        def alike(held: list[bytes], mark: bytes) -> np.ndarray:
            marks = np.frombuffer(b"".join(held), np.uint8).reshape(len(held), -1)
            return (marks == np.frombuffer(mark, np.uint8)).mean(axis=1) >= likely

        across = _compared(apart.join(marked, F.col("rep") == F.col("r")).select(*apart.columns, "marks"), "key", "marks", alike)
        inside = found
        found = stored(inside.unionByName(across))
        dropped(joined, apart, inside)
    dropped(mine)
    return found


def _alike(sets: list[bytes], one: bytes, threshold: float) -> np.ndarray:
    """Which sorted sets of 64-bit numbers have a Jaccard similarity of at least threshold with one."""
    v = np.frombuffer(one, np.uint64)
    size = np.array([len(x) // 8 for x in sets])
    fits = np.flatnonzero((size >= threshold * len(v)) & (threshold * size <= len(v)) & (size > 0)) if len(v) else np.zeros(0, np.int64)
    out = np.zeros(len(sets), dtype=bool)
    if len(fits):
        flat_ = np.frombuffer(b"".join(sets[i] for i in fits.tolist()), np.uint64)
        same = v[np.minimum(np.searchsorted(v, flat_), len(v) - 1)] == flat_
        common = np.bincount(np.repeat(np.arange(len(fits)), size[fits])[same], minlength=len(fits))
        out[fits] = (common > 0) & (common >= threshold * (size[fits] + len(v) - common))
    return out


def gram_sets(texts: DataFrame, words: int, weight: str) -> DataFrame:
    """rep and the sorted hashes of the text's shingles."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat.text_bytes(batch.column(1))
            for a, b in flat.cuts(np.diff(offsets), PASS_BYTES):
                grams, of, _, _ = shingles(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], words)
                grams, of, counts = _counted(grams, of)
                if weight == "count":  # the nth occurrence is an element of its own
                    of, again = np.repeat(of, counts), np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                    grams = flat.mixed(np.repeat(grams, counts) ^ flat.mixed(again.astype(np.uint64)))
                edge = np.searchsorted(of, np.arange(b - a + 1))
                rows = [np.sort(grams[x:y]).tobytes() for x, y in zip(edge, edge[1:], strict=False)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(rows, pa.binary())], ["rep", "grams"])

    return texts.select("rep", "text").mapInArrow(cut, "rep long, grams binary")


def along_edges(links: DataFrame, sets: DataFrame, threshold: float, slice_rows: int = 192) -> DataFrame:
    """The links whose sets are alike. A vertex with many links is met by its neighbours in slices, and goes to each
    slice once."""
    hubs = stored(links.groupBy("b").agg(F.count(F.lit(1)).alias("n")).select(F.col("b").alias("h"), "n", F.col("n").alias("all")))
    total = hubs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = looked_up(links, ["b"], hubs, ["h"], "n", total, ["a"])
    leaves = stored(met.select("a", "b", F.pmod(F.xxhash64("a"), F.ceil(F.col("all") / slice_rows).cast("int")).cast("int").alias("slice")))
    grams = sets.select(F.col("rep").alias("r"), "grams")
    here = leaves.join(grams, F.col("a") == F.col("r")).select("b", "slice", F.lit(1).alias("leaf"), F.col("a").alias("rep"), "grams")
    hub = leaves.select("b", "slice").distinct().join(grams, F.col("b") == F.col("r")).select("b", "slice", F.lit(0).alias("leaf"), F.col("b").alias("rep"), "grams")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = b""
        for new, part in _parts(batches, ["b", "slice"]):
            rep, values = part.column("rep"), part.column("grams").to_pylist()
            if new:
                one = values[0]
            ok = _alike(values, one, threshold)
            ok &= part.column("leaf").to_numpy() == 1
            yield pa.RecordBatch.from_arrays([rep.filter(pa.array(ok)), part.column("b").filter(pa.array(ok))], ["a", "b"])

    dealt = here.unionByName(hub).repartition("b", "slice").sortWithinPartitions("b", "slice", "leaf")
    out = stored(dealt.mapInArrow(run, "a long, b long"))
    dropped(hubs, leaves)
    return out


def true_links(texts: DataFrame, links: DataFrame, words: int, threshold: float, weight: str, block: int = 192) -> DataFrame:
    """Links of exact similarity that join up the same components as all such pairs inside each tree of `links`.
    texts: rep, text. The result is a stored table."""
    sets = stored(gram_sets(texts, words, weight))
    found = along_edges(links, sets, threshold, block)
    trees, joined = components(links), components(found)
    of_tree = trees.select(F.col("id").alias("rep"), F.col("component").alias("tree"))
    of_tree = of_tree.unionByName(of_tree.select(F.col("tree").alias("rep"), "tree").distinct())
    apart = _meetings(_with_component(of_tree, joined), "tree", block, max(1, sets.count()))
    grams = sets.select(F.col("rep").alias("r"), "grams")
    more = _compared(apart.join(grams, F.col("rep") == F.col("r")).select(*apart.columns, "grams"), "tree", "grams", lambda held, one: _alike(held, one, threshold))
    out = stored(found.unionByName(more))
    dropped(sets, found, trees, joined, apart)
    return out


def near_duplicates(docs: DataFrame, words: int = 5, threshold: float = 0.8, bands: int = 32, rows: int = 4, likely: float = 0.62, weight: str = "set", bucket_block: int = 1024, tree_block: int = 192) -> DataFrame:
    """doc_id, class_id (smallest doc_id with the same words), component_id (smallest doc_id reachable by links) and
    kept (doc_id = component_id, or no doc_id in the component), one row per row of docs."""
    sketches = stored(sketch(docs, words, bands, rows, weight))
    alike = sketches.where("f1 is not null").groupBy("f1", "f2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc", "tie")).alias("first"))
    classes = stored(alike.select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), "n", "first.*", F.monotonically_increasing_id().alias("rep")))
    lead = classes.select(F.col("doc").alias("ld"), F.col("tie").alias("lt"), "rep")
    heads = stored(sketches.join(lead, (F.col("doc") == F.col("ld")) & (F.col("tie") == F.col("lt"))).select("rep", "bands", "marks").dropDuplicates(["rep"]))
    links = likely_links(heads, likely, bucket_block)
    dropped(heads)
    ends = links.select(F.col("a").alias("e")).unionByName(links.select(F.col("b").alias("e"))).distinct()
    wanted = stored(lead.join(ends, F.col("rep") == F.col("e"), "left_semi"))
    same = (F.col("doc") == F.col("ld")) & (F.col("tie") == F.col("lt"))
    texts = _identity(docs).repartition(partitions_for(docs), "doc", "tie").join(wanted, same).select("rep", "text").dropDuplicates(["rep"])
    found = true_links(texts, links, words, threshold, weight, tree_block)
    joined = components(found)
    dropped(links, wanted, found)
    placed = stored(_with_component(classes.select("g1", "g2", "n", "doc", "rep"), joined))
    least = placed.groupBy("component").agg(F.min("doc").alias("least")).withColumnRenamed("component", "c")
    answers = stored(placed.join(least, F.col("component") == F.col("c")).select("g1", "g2", "n", F.col("doc").alias("class"), "least"))
    total = sketches.count()
    with_words = looked_up(sketches.where("f1 is not null").select("doc", "tie", "f1", "f2"), ["f1", "f2"], answers, ["g1", "g2"], "n", total, ["doc", "tie"]).select("doc", "class", "least")
    alone = sketches.where("f1 is null").select("doc", F.col("doc").alias("class"), F.col("doc").alias("least"))
    out = stored(with_words.unionByName(alone))
    dropped(sketches, classes, joined, placed, answers)
    name = lambda c: F.when(F.col(c) < _LAST, F.col(c))
    return out.select(name("doc").alias("doc_id"), name("class").alias("class_id"), name("least").alias("component_id"), (F.col("doc") == F.col("least")).alias("kept"))
