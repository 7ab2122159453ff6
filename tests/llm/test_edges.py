"""Null ids, clashing columns, repeated rows, long texts, and methods against brute force."""

import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from leafwright.llm import ann, langid, line_dedup, minhash, mixing, runtime
from leafwright.llm.hnsw import Graph

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_mixing_keeps_large_and_null_ids(spark):
    rows = [(2**60 + 12345, "a b c", "en", "s", 0), (2**60 + 12346, "a b", "en", "s", 0), (None, "x y", "en", "s", 0), (None, "x y", "en", "s", 0)]
    got = mixing.mix(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r["size"]) for r in got) == [(0, 2), (0, 2), (2**60 + 12345, 3), (2**60 + 12346, 2)]


def brute_runs(rows, shortest):
    """Text, lines, removed lines and runs of each document, by windows of the shortest run."""
    first, out = {}, {}
    kept_lines = {d: [x for x in t.split("\n") if x.strip(" ")] for d, t in rows}
    for d, s in sorted(kept_lines.items()):
        for i in range(len(s) - shortest + 1):
            first.setdefault(tuple(s[i : i + shortest]), (d, i))
    for d, t in rows:
        s = kept_lines[d]
        gone = [False] * len(s)
        for i in range(len(s) - shortest + 1):
            if first[tuple(s[i : i + shortest])] != (d, i):
                gone[i : i + shortest] = [True] * shortest
        kept, n = [], 0
        for x in t.split("\n"):
            if x.strip(" "):
                if not gone[n]:
                    kept.append(x)
                n += 1
            elif not (0 < n < len(gone) and gone[n - 1] and gone[n]):
                kept.append(x)
        runs = sum(g and (i == 0 or not gone[i - 1]) for i, g in enumerate(gone))
        out[d] = ("\n".join(kept) if any(gone) else t, len(s), sum(gone), runs)
    return out


@pytest.mark.parametrize("shortest", [2, 3])
def test_runs_of_many_lengths(spark, shortest):
    rng = random.Random(3)
    passages = [[f"p{n}_{i}" for i in range(n)] for n in (2, 3, 7, 40)]
    rows = []
    for d in range(50):
        lines = []
        for _ in range(rng.randint(1, 4)):
            lines += [f"u{rng.randrange(10**6)}" if rng.random() < 0.6 else rng.choice("abc") for _ in range(rng.randint(0, 6))]
            if rng.random() < 0.6:
                p = rng.choice(passages)
                lines += p if rng.random() < 0.6 else p[rng.randrange(len(p)) :]
            lines += ["", " "] if rng.random() < 0.4 else []
        rows.append((d, "\n".join(lines)))
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(docs, shortest).collect()}
    assert got == brute_runs(rows, shortest)


def test_runs_reach_their_full_length(spark):
    run = [f"l{i}" for i in range(40)]
    docs = spark.createDataFrame([(1, "\n".join(["a", *run, "b"]), "en", "s", 0), (2, "\n".join(["c", *run, "d"]), "en", "s", 0)], SCHEMA)
    levels = line_dedup.suffix_ranks(docs, 2)
    assert max(levels) == 64 and levels[32].count() == 2 * 9 and levels[64].count() == 0
    (shared,) = line_dedup.common_prefixes(line_dedup.later_copies(levels, 2), levels).where("line = 1").collect()
    assert (shared.doc, shared.shared, shared.home.doc, shared.home.line) == (2, 40, 1, 1)


def test_line_dedup_takes_any_column_names(spark):
    rows = [(1, "a\nb\n\npara two\n\npara three", 7, 8, 9, 5), (2, "a\nb\n\nx\n\ny", 7, 8, 9, 5), (None, None, 1, 1, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs int, doc int, rank int, n_removed int")
    out = line_dedup.line_dedup(docs)
    assert out.columns == ["doc_id", "text", "runs", "doc", "rank", "n_lines", "n_removed", "n_runs"]
    got = {r.doc_id: (r.text, r.runs, r.doc, r.n_removed) for r in out.collect()}
    assert got == {1: ("a\nb\n\npara two\n\npara three", 7, 8, 0), 2: ("\nx\n\ny", 7, 8, 2), None: (None, 1, 1, 0)}


def phrases(text: str, sample: str) -> int:
    """One more than how often the current match cannot go on with the next letter and starts anew with it."""
    n, match = 1, ""
    for c in text:
        if match + c in sample:
            match += c
        else:
            n, match = n + 1, c if c in sample else ""
    return n


def test_language_winner_and_score_by_brute_force():
    rng = random.Random(4)
    samples = {k: "".join(rng.choices(letters, k=900)) for k, letters in {"aa": "abcde ", "bb": "defgh ", "cc": "aeiou "}.items()}
    parser = langid.CrossParser(samples)
    plain = {k: re.sub(" +", " ", x) for k, x in samples.items()}
    for k in ("aa", "bb", "cc"):
        text = " ".join("".join(rng.choices(samples[k].replace(" ", ""), k=6)) for _ in range(20))
        found, _ = parser.phrases([text])
        assert found[0].tolist() == [phrases(text, plain[x]) for x in parser.languages]
        lang, score, _ = parser.predict([text])
        cost = found[0] * np.log2([len(samples[x]) + 2 for x in parser.languages])
        assert lang == [parser.languages[int(cost.argmin())]] and score[0] == pytest.approx(1 / ((cost.min() / cost) ** 8).sum())


def test_a_script_of_many_letters_stays_small_and_foreign_texts_are_told():
    rng = random.Random(1)
    han = "".join(chr(0x4E00 + rng.randrange(3000)) for _ in range(20_000))
    parser = langid.CrossParser({"zh": han, "en": "the quick brown fox jumps over the lazy dog " * 50})
    assert sum(x.nbytes for x in (parser.ways.ways, parser.ways.keys, parser.ways.ends, parser.ways.rows, parser.ways.first)) < 40 << 20
    lang, _, foreign = parser.predict([han[500:900], "the lazy fox " * 20, "быстро" * 30])
    assert lang[:2] == ["zh", "en"] and foreign.tolist() == [False, False, True]


def test_building_holds_one_automaton_at_a_time():
    rng = random.Random(2)

    def peak(n):
        samples = {f"l{k}": "".join(rng.choices("abcdefghijklmnop ", k=20_000)) for k in range(n)}
        tracemalloc.start()
        try:
            langid.CrossParser(samples)
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(6) < 2 * peak(1)


def test_accepted_passes_batches_on_in_parts(monkeypatch):
    texts = ["la lo li lu " * 20, None, "ob ab ib ub " * 20, "12 !?", "", "быстро " * 30, "la lo " * 30]
    batch = pa.record_batch({"text": texts, "lang": pa.array([None, "aa", "bb", None, None, "aa", None], pa.string()), "n": list(range(7))})
    parser = langid.CrossParser({"aa": "la lo li lu " * 30, "bb": "ob ab ib ub " * 30})
    whole = pa.Table.from_batches(langid.accepted_batches([batch], parser)).to_pylist()
    assert [(r["n"], r["lang"]) for r in whole] == [(0, "aa"), (2, "bb"), (6, "aa")]
    monkeypatch.setattr(langid, "PASS_CHARS", 100)
    parts = list(langid.accepted_batches([batch], parser))
    assert max(x.num_rows for x in parts) == 1 and pa.Table.from_batches(parts).to_pylist() == whole


def test_stretches_cover_long_texts(spark):
    from pyspark.sql import functions as F

    text = "".join(chr(97 + i % 26) * 1000 for i in range(8))
    (row,) = spark.createDataFrame([(text,)], "t string").select(langid.stretches(F.col("t"), F.lit(5), 800).alias("s")).collect()
    assert [set(x) for x in row.s.split(" ")] == [{c} for c in "abcdefgh"] and len(row.s) == 807


def test_repeated_rows_and_shared_ids(spark):
    """Rows are documents: equal rows are one class, one id with two texts is in two groups."""
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (1, a), (1, b), (2, b), (None, a), (None, None)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(docs).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True)], key=repr)


def test_one_of_several_equal_rows_stays(spark):
    import corpus_pipeline

    text = " ".join(f"w{i}" for i in range(30))
    docs = spark.createDataFrame([(5, text, "en", "s", 0)] * 3 + [(None, text, "en", "s", 0), (6, None, "en", "s", 0)], SCHEMA)
    kept = corpus_pipeline.near_duplicates(spark, docs, "").collect()
    assert sorted(r.text or "" for r in kept) == ["", text]
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_codes_decide_what_is_measured():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 16))
    q = ann.Quantiser(x[:1000])
    codes = q.encode(x)
    square, off = q.bounds(x, codes)
    best, least = ann._bounded(x[:5], (x * x).sum(axis=1) / 2, codes, square, off, q, 40)
    hit = 0
    for i in range(5):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        assert (least[i] <= d + 1e-9).all()  # a bound, so that nothing nearer is left out
        hit += len(set(np.argsort(d)[:10]) & set(best[i]))
    assert best.shape[1] == 41 and hit >= 40


def test_dense_group_is_found_whole():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(900, 32))
    x[:700] = x[0] + 0.02 * rng.normal(size=(700, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]
    graph, q = Graph(x), x[::7].astype(np.float32)
    assert (graph.within(q, 0.95) == (q @ graph.v.T >= 0.95)).all()


def test_a_cluster_must_name_its_folder():
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext, conf = Context(), {}  # noqa: N815

    with pytest.raises(RuntimeError):
        runtime.shared_dir(Session())
