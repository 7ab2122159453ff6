"""Operators over texts against brute force, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from leafwright.llm import anchors, chat, flat, langid, line_dedup, minhash, mixing, packing, substring, suffix_dedup
from leafwright.llm.grouping_sort import common_prefixes, suffix_array

WORDS = ["alpha", "beta", "gamma", "delta", "é", "the", "of", "x", "ñandú", "zeta", "omega", "rho"]


def corpus(seed: int, n: int = 40) -> list[tuple]:
    rng = random.Random(seed)
    passages = [" ".join(rng.choices(WORDS, k=60)) for _ in range(4)]
    rows = []
    for i in range(n):
        parts = [" ".join(rng.choices(WORDS, k=rng.randint(0, 80))) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages)[rng.randint(0, 30) :])
        rows.append((i * 3 % 101, ("\n" if rng.random() < 0.5 else "  ").join(parts), "en", f"src{i % 3}", 0))
    rows += [(200, rows[0][1], "en", "src0", 0), (201, rows[0][1], None, None, 0), (202, None, "en", None, 0), (203, "", None, "src1", 0), (204, "aba " * 300, "en", "src1", 0), (205, "zaba " + "aba " * 200, "en", "src1", 0), (206, "   \n\t ", "en", "src1", 0)]
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def test_suffix_array_matches_sorting():
    rng = random.Random(1)
    for _ in range(400):
        t = [rng.randint(1, rng.randint(1, 4)) for _ in range(rng.randint(1, 40))] + [0]
        order = suffix_array(np.array(t))
        assert order == sorted(range(len(t)), key=lambda i: t[i:])
        shared = common_prefixes(t, order)
        for r in range(1, len(t)):
            a, b = t[order[r - 1] :], t[order[r] :]
            assert shared[r] == next((k for k in range(min(len(a), len(b))) if a[k] != b[k]), min(len(a), len(b)))


def brute_bytes(rows, length):
    first = {}
    for d, t in sorted((r[0], r[1] or "") for r in rows):
        b = t.encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], d)
    out = []
    for d, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < d:
                gone[i : i + length] = b"\1" * length
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_suffix_dedup(spark, seed):
    rows = corpus(seed)
    got = suffix_dedup.suffix_dedup(frame(spark, rows), with_text=False).drop("kept").collect()
    assert sorted(map(tuple, got)) == brute_bytes(rows, 50)


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup(spark, seed):
    rows, length, seen = corpus(seed), 35, Counter()
    split = [re.findall(r"[^\x20\x09-\x0D]+", r[1] or "") for r in rows]
    for w in split:
        seen.update(tuple(w[i : i + length]) for i in range(len(w) - length + 1))
    want = []
    for r, w in zip(rows, split, strict=True):
        gone = [False] * len(w)
        for i in range(len(w) - length + 1):
            if seen[tuple(w[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        want.append((r[0], len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substring.substring_dedup(frame(spark, rows), with_text=False).drop("kept").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_long_texts_are_cut_with_overlap(spark, monkeypatch):
    monkeypatch.setattr(anchors, "STRETCH", 200)
    windows = anchors.Windows(50, 16, words=False)
    data = np.frombuffer(random.Random(3).randbytes(1500), np.uint8)
    runs = list(windows.anchors(flat.BYTE_HASH[data], np.array([0, 1500])))
    starts = sorted(s for _, _, a, b in runs for x, y in zip(a, b, strict=True) for s in range(x, y + 1))
    assert starts == list(range(1451))


def test_words_and_hashes():
    data, offsets = flat.text_bytes(__import__("pyarrow").array(["ab  cd", None, "", "cd", " ab"]))
    starts, ends, at = flat.words_of(data, offsets)
    h = flat.word_hash(data, starts, ends)
    assert at.tolist() == [0, 2, 2, 2, 3, 4]
    assert h[0] == h[3] and h[1] == h[2] and h[0] != h[1]


def test_empty_tables(spark):
    docs = spark.createDataFrame([], SCHEMA)
    assert suffix_dedup.suffix_dedup(docs).count() == 0
    assert substring.substring_dedup(docs).count() == 0
    assert minhash.near_duplicates(docs).count() == 0
    assert mixing.mix(docs).count() == 0
    assert packing.best_fit_packing(docs).count() == 0
    assert langid.identify(docs).count() == 0
    assert line_dedup.line_dedup(docs).count() == 0


def test_near_duplicates(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(500)]
    rows = []
    for i in range(60):
        base = rng.choices(vocabulary, k=120)
        rows.append((i, " ".join(base), "en", "s", 0))
        for c in range(rng.choice([0, 0, 1, 3])):
            near = list(base)
            for _ in range(rng.randint(0, 4)):
                near[rng.randrange(len(near))] = "changed"
            rows.append((1000 + 10 * i + c, "  ".join(near), None, None, 0))
    rows += [(5000, "one two", "en", "s", 0), (5001, "one  two", "en", "s", 0), (5002, None, "en", "s", 0), (5003, "", "en", "s", 0), (None, "one two", "en", "s", 0)]
    sets = {r[0]: {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (r[1] or "").split()) else set() for r in rows if r[0] is not None}
    label = {d: d for d in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    for weight in ("set", "count"):
        blocks = {} if weight == "set" else {"bucket_block": 2, "tree_block": 2}  # small ones: classes meet as visitors
        got = {r.doc_id: r for r in minhash.near_duplicates(frame(spark, rows), weight=weight, **blocks).collect()}
        assert {d: got[d].component_id for d in label} == label
        assert got[None].component_id == got[None].class_id == 5000 and not got[None].kept


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(2)
    elements = rng.integers(1, 1 << 62, 200).astype(np.uint64)
    a, b = rng.integers(1, 5, 200).astype(float), rng.integers(1, 5, 200).astype(float)
    s = minhash.dart_minhash(np.concatenate([elements, elements]), np.concatenate([a, b]), np.repeat([0, 1], 200), 2, 2000)
    assert abs((s[0] == s[1]).mean() - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04


def test_line_runs(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\nc\n\ny"), (3, "b\nc"), (4, "c\nb"), (5, "q\nq\nq\nq"), (6, None), (7, ""), (8, "b\nb"), (3, "b\nc")]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(docs).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0, 0), 2: ("x\n\ny", 4, 2, 1), 3: ("", 2, 2, 1), 4: ("c\nb", 2, 0, 0), 5: ("q", 4, 3, 1), 6: (None, 0, 0, 0), 7: ("", 0, 0, 0), 8: ("b\nb", 2, 0, 0)}
    longer = line_dedup.line_dedup(docs.where("doc_id <= 2"), min_run=3)
    assert longer.where("n_removed > 0").count() == 0


def test_long_lines_alone(spark):
    """Lines of ten words or more go from one on, one-line documents too; shorter ones only in runs of two."""
    import corpus_pipeline

    a, b, short = " ".join(f"a{i}" for i in range(10)), " ".join(f"b{i}" for i in range(60)), " ".join(f"s{i}" for i in range(9))
    texts = [b, f"x\n{a}\ny", f"{short}\n{a}\nz", b, f"q\n{short}\nr", f"x\n{a}\ny\n{b}\nend", f"{a}\n{a}"]
    docs = spark.createDataFrame([(i, t, "en", "web", len(t)) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_removed, r.n_runs) for r in line_dedup.line_dedup(docs, alone=10).collect()}
    assert got == {0: (b, 0, 0), 1: (texts[1], 0, 0), 2: (f"{short}\nz", 1, 1), 3: ("", 1, 1), 4: (texts[4], 0, 0), 5: ("end", 4, 1), 6: ("", 2, 1)}
    assert {r.doc_id: r.text for r in corpus_pipeline.lines(spark, docs, "").collect()} == {i: t for i, (t, *_) in got.items() if t}


def test_line_runs_of_three(spark):
    docs = spark.createDataFrame([(1, "a\nb\nc\nd\ne", "en", "s", 0), (2, "z\nb\nc\nd\ny", "en", "s", 0), (3, "c\nd", "en", "s", 0)], SCHEMA)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs, min_run=3).collect()}
    assert got == {1: "a\nb\nc\nd\ne", 2: "z\ny", 3: "c\nd"}


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(i, "w " * rng.randint(0, 60), "en", rng.choice(["a", "b", None, "c"]), 0) for i in range(600)] + [(5, "w", "en", "a", 0)] * 3
    got = mixing.mix(frame(spark, rows), leaf_rows=20, fan_in=4).toPandas()
    again = mixing.mix(frame(spark, rows).repartition(7), leaf_rows=20, fan_in=4).toPandas()
    key = ["doc_id", "size", "taken"]
    assert got[key].sort_values(key).values.tolist() == again[key].sort_values(key).values.tolist()
    assert len(got) == len(rows) and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 5
    total = got["size"].sum()
    assert got.drop_duplicates("source").target.sum() == pytest.approx(total)


def test_targets_stop_at_three_times_the_source(spark):
    sizes = spark.createDataFrame([("a", 100), ("b", 1), ("c", 10), (None, 100)], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(sizes).collect()}
    assert got["b"] == 3 and got["c"] == 30 and got["a"] == got[None] == pytest.approx(89.0)


def test_pivot_keeps_the_words():
    rng = random.Random(3)
    p, size = [rng.random() for _ in range(200)], [rng.randint(1, 50) for _ in range(200)]
    q = list(p)
    rest = mixing.pivot(q, size, [rng.random() for _ in p])
    assert all(x in (0, 1) for i, x in enumerate(q) if i != rest)
    assert sum(x * s for x, s in zip(q, size, strict=True)) == pytest.approx(sum(x * s for x, s in zip(p, size, strict=True)))


def test_packing(spark):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    rows = corpus(3) + [(300, "Don't STOP " * 1500, "en", "s", 0), (301, "Σίσυφος ΟΔΟΣ 日本 x²", "en", "s", 0), (302, "<|endoftext|> a", "en", "s", 0)]
    got = packing.best_fit_packing(frame(spark, rows)).toPandas()
    for doc_id, text, *_ in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        mine = got[got.doc_id == doc_id].sort_values("piece")
        assert mine.start.tolist() == list(range(0, len(ids), 2048))
        for r in mine.itertuples():
            part = np.array(ids[r.start : r.start + r.length], "<u4").tobytes()
            assert r.ids_crc32 == __import__("zlib").crc32(part)
        assert mine.length.sum() == len(ids)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == [0, *g.length.cumsum().tolist()[:-1]] and g.length.sum() <= 2048


def test_best_two_fit_trades_one_for_two():
    assert sorted(map(sorted, packing.best_two_fit([6, 3, 2, 2], 10))) == [[2, 2, 6], [3]]
    rng = random.Random(4)
    lengths = [rng.randint(1, 900) for _ in range(3000)]
    bins = packing.best_two_fit(lengths, 2048)
    assert sorted(x for b in bins for x in b) == sorted(lengths) and all(sum(b) <= 2048 for b in bins)
    assert len(bins) <= -(-sum(lengths) // 2048) + 1


def test_language(spark):
    rng = random.Random(8)
    parts = {"aa": ["ba", "lo", "mi", "tu"], "bb": ["sch", "ung", "keit", "der"], "cc": ["qu", "eau", "tion", "oi"]}
    rows = [(i, " ".join("".join(rng.choices(parts[k], k=3)) for _ in range(40)), k, "s", 0) for i, k in enumerate(rng.choices(list(parts), k=150))]
    rows += [(900, None, "aa", "s", 0), (901, "123 !?", None, "s", 0), (902, "", "bb", "s", 0)]
    docs = frame(spark, rows)
    got = {r.doc_id: r for r in langid.identify(docs).collect()}
    import zlib

    assert all(got[r[0]].held_out == (zlib.crc32(str(r[0]).encode()) % 5 == 0) for r in rows)
    assert all(got[r[0]].lang_pred == r[2] for r in rows[:150] if got[r[0]].held_out)
    assert all(got[d].lang_pred == "und" and got[d].score == 0 for d in (900, 901, 902))
    assert langid.accepted(docs).count() == 150


def test_parsing_matches_greedy_phrases():
    parser = langid.CrossParser({"x": "abracadabra abba"})
    reference = "abracadabra abba"

    def greedy(text):
        n, at = 0, 0
        while at < len(text):
            k = 1
            while at + k < len(text) and " " + reference in " " + reference and text[at : at + k + 1] in reference:
                k += 1
            n, at = n + 1, at + k
        return n

    for text in ("abra", "zabba", "abracadabra", "cada abba bra"):
        assert parser.phrases([text])[0][0, 0] == greedy(text)


def test_rotation(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "ann", "hi <|im_end|>"), (1, 2, "bob", None), (2, None, None, "x"), (3, 0, "system", "alone"), (None, 300, "ann", "late")]
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert set(got) == {(1, "ann", 0), (1, "bob", 0), (2, "unknown", 0), (None, "ann", 0)}
    r = got[1, "ann", 0]
    assert r.rendered == "<|im_start|>system\nbe kind<|im_end|>\n<|im_start|>assistant\nhi < |im_end|><|im_end|>\n<|im_start|>user name=bob\n<|im_end|>\n"
    a, b = map(int, r.mask_spans.split("-"))
    assert r.rendered[a:b] == "hi < |im_end|><|im_end|>\n" and r.n_learned == 1
    assert got[1, "bob", 0].rendered.count("assistant") == 1


def test_rotation_of_a_long_conversation(spark):
    """Null turns come last, equal turns and repeated rows share parts of bounded size, small conversations stay whole."""
    rows = [(1, t, "ann" if t % 2 else "bob", f"m{t:04d}") for t in range(300)] + [(1, None, "ann", f"late{k:03d}") for k in range(100)]
    rows += [(2, 7, "cid", "same")] * 70 + [(c, 0, "dee", "hi") for c in range(10, 40)]
    docs = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(5)
    got = {(r.conv_id, r.perspective, r.part): r for r in chat.rotate(docs, turns_per_part=32).collect()}
    order = sorted((r for r in rows if r[0] == 1), key=lambda r: (r[1] is None, r[1] or 0, r[2], r[3]))
    for who in ("ann", "bob"):
        for part in range(13):
            r = got[1, who, part]
            assert re.findall("m[0-9]{4}|late[0-9]{3}", r.rendered) == [x[3] for x in order[32 * part : 32 * part + 32]]
    assert [got[2, "cid", p].n_messages for p in range(3)] == [32, 32, 6] and got[20, "dee", 0].n_learned == 1
    assert len(got) == 2 * 13 + 3 + 30
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.rotate(empty).count() == 0
