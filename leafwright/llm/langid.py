"""Language identification by cross-parsing.

For each language a suffix automaton of a bounded sample of labelled text accepts exactly the strings that occur in
that sample. A text is parsed against each automaton: phrases are longest matches, one after the other. Few phrases
mean low cross-entropy, so the language whose phrase count, times the bits that name a place in its sample, is
smallest wins.

The sample is bounded by `docs_per_language` times `chars_per_doc` characters a language, whatever the corpus: a document
gives stretches from its whole length, one from each of `STRETCHES` equal parts at a hashed place. The prediction reads
every whole text. Texts are lower-cased, letters stay, everything else becomes one separator. Parsing runs many stretches
of `STRETCH` symbols side by side; a phrase ends where its stretch ends.

Transitions are kept sparse: a state's first one with the state, further ones in a hash table; only states with many ways,
near the start, have a row by letter, and there are fewer of those the more letters there are. So memory follows the
length of the samples, not the number of letters of a script.

Defined results: null text, or text without a letter: `und`, score 0; no labelled text at all: every text is `und`;
ties go to the label that sorts first; repeated rows get the same answer; a null doc_id is never held out, and comes back
as null; an empty table gives an empty table; other columns are ignored by `identify` and kept by `accepted`.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafwright.llm.flat import cuts

STRETCH = 512
#: Parts of a document that give a stretch each to the sample.
STRETCHES = 8
#: Characters that one pass holds at a time.
PASS_CHARS = 1 << 20
SEPARATOR, UNKNOWN = 1, 0
#: A text of so many letters is foreign if its phrases have fewer letters than this on average. Random letters of a known
#: alphabet reach three and more, related languages four, a script that no sample has one.
FOREIGN_LETTERS, FOREIGN_MATCH = 50, 2.0

PREDICTION = "doc_id long, lang_pred string, score double"


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Transitions of each state of the automaton of all substrings; state 0 is the start."""
    step: list[dict[int, int]] = [{}]
    link, size, last = [-1], [0], 0
    for c in symbols:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p != -1 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p != -1:
            q = step[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p != -1 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
                link[q] = link[new] = twin
        last = new
    return step


class Transitions:
    """The transitions of several automata, whose states are numbered through. 0 stands for no way on."""

    def __init__(self, automata: Iterable[list[dict[int, int]]], width: int):
        # of each state, in one number: the first letter that leads on, where to, and 0 or 1 if that is all or there are
        # more; or the row of a state with many ways, and 2
        many = max(4, width // 16)
        start, first, ways_of, states, letters, ends, rows, base = [], [], [], [], [], [], [], 0
        for steps in automata:  # one automaton is held at a time, as objects it takes ten times the room of its arrays
            letter, to, kind = np.full(len(steps), -1, np.int64), np.zeros(len(steps), np.int64), np.zeros(len(steps), np.int64)
            begin = np.zeros(width, np.int32)
            more_of, more_by, more_to = array("q"), array("q"), array("i")
            for c, t in steps[0].items():
                begin[c] = base + t
            for s, ways in enumerate(steps):
                if len(ways) > many:
                    to[s], kind[s] = len(rows), 2
                    row = np.zeros(width, np.int32)
                    row[list(ways)] = [base + t for t in ways.values()]
                    rows.append(row)
                    continue
                more = iter(ways.items())
                for c, t in more:
                    letter[s], to[s] = c, base + t
                    break
                for c, t in more:
                    kind[s] = 1
                    more_of.append(base + s)
                    more_by.append(c)
                    more_to.append(base + t)
            start.append(base)
            first.append(begin)
            ways_of.append(letter << 34 | to << 2 | kind)
            states.append(np.array(more_of, np.int64))
            letters.append(np.array(more_by, np.int64))
            ends.append(np.array(more_to, np.int32))
            base += len(steps)
            del steps, ways, more
        self.start = np.array(start, dtype=np.int64)
        self.first = np.array(first, np.int32).reshape(len(start), width)
        self.ways = np.concatenate(ways_of) if ways_of else np.zeros(0, np.int64)
        self.rows = np.concatenate(rows) if rows else np.zeros(width, np.int32)
        self.width = width
        to = np.concatenate([np.zeros(0, np.int32), *ends])
        keys = np.concatenate([np.zeros(0, np.int64), *states]) * width + np.concatenate([np.zeros(0, np.int64), *letters])
        self.bits = max(4, int(2 * len(keys) + 1).bit_length())
        self.keys, self.ends = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):  # one of the keys that want a free slot gets it, the others go on to the next
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]
            got = self.keys[at[left]] == keys[left]
            self.ends[at[left[got]]] = to[left[got]]
            left = left[~got]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def follow(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where state goes with c; both flat, of one length."""
        ways = self.ways[state]
        kind, to = ways & 3, ways >> 2 & (1 << 32) - 1
        fits = (ways >> 34) == c
        out = np.where(fits, to, 0)
        dense = np.flatnonzero(kind == 2)
        out[dense] = self.rows[to[dense] * self.width + c[dense]]
        left = np.flatnonzero((kind == 1) & ~fits)
        keys = state[left].astype(np.int64) * self.width + c[left]
        at = self._slot(keys)
        while len(left):
            found = self.keys[at]
            hit = found == keys
            out[left[hit]] = self.ends[at[hit]]
            on = ~hit & (found >= 0)
            left, keys, at = left[on], keys[on], (at[on] + 1) & ((1 << self.bits) - 1)
        return out

    def restart(self, language: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Where a phrase that begins with c stands."""
        begin = self.first[language, c]
        return np.where(begin == 0, self.start[language], begin)


class CrossParser:
    def __init__(self, samples: dict[str, str]):
        self.languages = sorted(samples)
        letters = sorted({c for x in samples.values() for c in x.lower() if c.isalpha()})
        self.symbol = np.full(0x110000, SEPARATOR, dtype=np.int32)
        self.symbol[[i for i in range(0x110000) if chr(i).isalpha()]] = UNKNOWN
        for k, c in enumerate(letters, start=2):
            self.symbol[ord(c)] = k
        automata = (suffix_automaton([int(s) for s in self.symbols([samples[x]])[0] if s != UNKNOWN]) for x in self.languages)
        self.ways = Transitions(automata, len(letters) + 2)
        self.bits = np.log2([len(samples[x]) + 2 for x in self.languages])

    def symbols(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All texts' symbols with runs of separators collapsed, each text's end, and each text's letters."""
        low = [x.lower() for x in texts]
        s = self.symbol[np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), dtype="<u4")]
        ends = np.cumsum([len(x) for x in low])
        apart = s == SEPARATOR
        keep = np.ones(len(s), dtype=bool)
        keep[1:] = ~(apart[1:] & apart[:-1])
        keep[ends[:-1][ends[:-1] < len(s)]] = True
        run = np.zeros(len(s) + 1, np.int32)
        np.cumsum(~apart, dtype=np.int32, out=run[1:])
        letters = (run[ends] - run[np.concatenate([[0], ends[:-1]])]).astype(np.int64)
        np.cumsum(keep, dtype=np.int32, out=run[1:])
        return s[keep], run[ends].astype(np.int64), letters

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Phrases by text and language, and each text's letters."""
        s, ends, letters = self.symbols(texts)
        begins = np.concatenate([[0], ends[:-1]])
        parts = -(-(ends - begins) // STRETCH)
        text = np.repeat(np.arange(len(texts)), parts)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)
        start = begins[text] + nth * STRETCH
        size = np.minimum(ends[text] - start, STRETCH)
        order = np.argsort(-size, kind="stable")
        start, size, text = start[order], size[order], text[order]
        active = np.searchsorted(-size, -np.arange(STRETCH), side="left")
        state = np.repeat(self.ways.start[:, None], len(start), axis=1).astype(np.int32)
        missed = np.zeros(state.shape, dtype=np.int64)
        for t in range(int(size[0]) if len(size) else 0):
            n = active[t]
            c = s[start[:n] + t]
            to = self.ways.follow(state[:, :n].ravel(), np.tile(c, len(self.languages)))
            miss = np.flatnonzero(to == 0)
            to[miss] = self.ways.restart(miss // n, c[miss % n])
            missed.ravel()[miss // n * missed.shape[1] + miss % n] += 1
            state[:, :n] = to.reshape(len(self.languages), n)
        out = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(text, weights=missed[k] + 1, minlength=len(texts))
        return out, letters

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Each text's language and score, and whether it is foreign to all: a text of some length whose longest matches
        hold hardly more than single letters in every language."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
        found, letters = self.phrases(texts)
        cost = np.maximum(found, 1) * self.bits
        best = cost.argmin(axis=1)
        weight = (cost.min(axis=1, keepdims=True) / cost) ** 8
        known = letters > 0
        score = np.where(known, 1 / weight.sum(axis=1), 0.0)
        foreign = (letters >= FOREIGN_LETTERS) & (letters < FOREIGN_MATCH * np.maximum(found, 1).min(axis=1))
        return [self.languages[b] if k else "und" for b, k in zip(best, known, strict=True)], score, foreign


#: Parsers by their samples; a Python worker builds one and keeps it for its later tasks.
_BUILT: dict[tuple, CrossParser] = {}


def _parser(samples: dict[str, str]) -> CrossParser:
    key = tuple(sorted(samples.items()))
    if key not in _BUILT:
        _BUILT.clear()
        _BUILT[key] = CrossParser(samples)
    return _BUILT[key]


def stretches(text: Column, seed: Column, chars: int, parts: int = STRETCHES) -> Column:
    """At most `chars` characters of a text: all of it, or one stretch from each of so many equal parts of its length."""
    each = chars // parts
    room = F.floor(F.length(text) / parts).cast("int") - each  # what is free in each part
    begin = lambda i: i * (room + each) + F.pmod(F.xxhash64(seed, i), room + 1).cast("int") + 1
    cut = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, begin(i), F.lit(each)))
    return F.when(F.length(text) <= chars, text).otherwise(F.array_join(cut, " "))


def sample(docs: DataFrame, docs_per_language: int = 96, chars_per_doc: int = 800) -> dict[str, str]:
    """The learning text of each language; docs: the labelled rows that may be learned from. What reaches the driver is
    at most docs_per_language * chars_per_doc characters for each distinct label."""
    rank = Window.partitionBy("lang").orderBy("h", "doc_id", "text")
    rows = (
        docs.where("lang is not null and text is not null")
        .select("doc_id", F.col("lang").cast("string"), "text", F.xxhash64("doc_id", "text").alias("h"))
        .withColumn("nth", F.row_number().over(rank))
        .where(F.col("nth") <= docs_per_language)
        .select("lang", "nth", stretches(F.col("text"), F.col("h"), chars_per_doc).alias("text"))
        .collect()
    )
    out: dict[str, str] = {}
    for r in sorted(rows, key=lambda r: (r.lang, r.nth)):
        out[r.lang] = out.get(r.lang, "") + " " + r.text
    return out


def predict(docs: DataFrame, samples: dict[str, str]) -> DataFrame:
    """doc_id, lang_pred and score of every row of docs."""
    sent = docs.sparkSession.sparkContext.broadcast(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = _parser(sent.value)
        for batch in batches:
            texts = batch.column(1)
            size = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(texts), 0))
            for a, b in cuts(size, PASS_CHARS):
                lang, score, _ = parser.predict(texts.slice(a, b - a).fill_null("").to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, PREDICTION)


def held_out(doc_id: Column | str = "doc_id", folds: int = 5) -> Column:
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, folds: int = 5) -> DataFrame:
    """Learns from the rows that are not held out, predicts all."""
    known = sample(docs.where(~held_out(folds=folds)))
    out = predict(docs, known)
    return out.select("doc_id", held_out(folds=folds).alias("held_out"), "lang_pred", "score")


def accepted_batches(batches: Iterable[pa.RecordBatch], parser: CrossParser) -> Iterator[pa.RecordBatch]:
    """`accepted` on batches. Each pass goes on its own, so that a batch of whole texts is not held twice."""
    for batch in batches:
        at, lang_at = batch.schema.get_field_index("text"), batch.schema.get_field_index("lang")
        size = np.asarray(pa.compute.fill_null(pa.compute.utf8_length(batch.column(at)), 0))
        for a, b in cuts(size, PASS_CHARS):
            part = batch.slice(a, b - a)
            found, _, foreign = parser.predict(part.column(at).fill_null("").to_pylist())
            lang = pa.compute.coalesce(part.column(lang_at), pa.array(found, part.column(lang_at).type))
            columns = [lang if i == lang_at else c for i, c in enumerate(part.columns)]
            kept = pa.array([x != "und" and not f for x, f in zip(found, foreign.tolist(), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(kept)


def accepted(docs: DataFrame, folds: int = 5) -> DataFrame:
    """The rows of docs whose text is in a known language, where they are, with a null lang filled in.

    Rejected is what `predict` calls `und`, and what is foreign to every language (CrossParser.predict). Learns as `identify` does. Needs the columns text and lang."""
    sent = docs.sparkSession.sparkContext.broadcast(sample(docs.where(~held_out(folds=folds))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from accepted_batches(batches, _parser(sent.value))

    return docs.mapInArrow(run, docs.schema)
