"""Streams against the same rules over finished tables."""

from leafwright.functions.unicode import normalized
from leafwright.sources import pages, sinks
from leafwright.streaming.memory import Memory, remembered


def test_memory_forgets_into_its_summary():
    memory = Memory(recent=2, most_chars=60, summary_chars=20)
    for k in range(5):
        memory.add("user", f"- point number {k}")
    assert [t for _, t in memory.messages] == ["- point number 3", "- point number 4"]
    assert memory.summary == "- point number 0\n- po"[:20]


def test_remembered(spark, tmp_path):
    rows = [(c, t, "user", f"- note {c} {t}") for c in (1, 2) for t in range(6)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("conv_id long, turn long, role string, text string").parquet(str(tmp_path / "in"))
    query = remembered(stream, recent=4).writeStream.format("memory").queryName("remembered").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.conv_id, r.turn): r for r in spark.table("remembered").collect()}
    assert len(got) == 12 and got[1, 5].n_messages == 4
    assert got[2, 5].summary == "- note 2 0\n- note 2 1"


def test_files_and_gates(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF")
    (tmp_path / "b.png").write_bytes(b"x")
    (tmp_path / "c.txt").write_bytes(b"x")
    got = {r.path.rsplit("/", 1)[1]: (r.mime, r.error_code) for r in pages.files(spark, str(tmp_path)).collect()}
    assert got == {"a.pdf": ("application/pdf", None), "b.png": ("image/png", None)}


def test_envelopes(spark):
    df = spark.createDataFrame([(1, 1, "b"), (1, 0, "a")], "doc_id long, page_index long, text string")
    body = sinks.envelopes(df).first().envelope
    assert body == '{"phase":"1.0.0","results":{"pages":[{"index":0,"text":"a","chars":1},{"index":1,"text":"b","chars":1}]},"metrics":{"pages":2},"errors":[]}'


def test_normal_form(spark):
    df = spark.createDataFrame([(1, "é"), (2, "é"), (3, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in normalized(df).collect()} == {1: "é", 2: "é", 3: None}
