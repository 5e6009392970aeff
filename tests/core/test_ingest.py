import numpy as np
import pytest
from pyspark.sql import functions as F

from lexiflume.operators import chunking, generation, vectors
from lexiflume.operators.bm25 import Bm25Index
from lexiflume.operators.topk import Best
from lexiflume.sources.graph_store import GraphStore
from lexiflume.sources.markdown import chunk_and_save
from lexiflume.sources.parts import PartTable
from lexiflume.sources.reports import ReportWriter, read_report


def test_best_equals_sorting():
    r = np.random.default_rng(4)
    for k in (0, 1, 7, 500):
        keys, scores = r.permutation(300), np.round(r.random((5, 300)), 1)
        best = Best(5, k)
        for a in range(0, 300, 40):
            best.add(keys[a : a + 40], scores[:, a : a + 40])
        for q in range(5):
            want = sorted(zip(-scores[q], keys, strict=True))[:k]
            assert sorted(zip(-best.scores[q], best.keys[q], strict=True)) == want


def test_search_in_blocks_equals_one_block(spark, monkeypatch):
    from lexiflume.operators import bm25

    docs = spark.createDataFrame([(i, " ".join(f"w{(i * j) % 17}" for j in range(i % 9)) if i % 11 else None) for i in range(120)], "doc_id long, text string")
    asked = spark.createDataFrame([(i, f"w{i} w{i + 1} w{i} unknown" if i % 5 else "") for i in range(20)], "query_id long, query string")
    index = Bm25Index.build(docs)
    want = sorted(map(tuple, index.search(asked, 10).select("query_id", "doc_id", "bm25_rank").collect()))
    assert len(want) == 200
    monkeypatch.setattr(bm25, "QUERY_BLOCK", 3)
    monkeypatch.setattr(bm25, "CELLS", 50)
    assert sorted(map(tuple, index.search(asked, 10).select("query_id", "doc_id", "bm25_rank").collect())) == want


def test_stored_index_follows_its_table(spark, tmp_path):
    path = f"file://{tmp_path}/docs.parquet"
    spark.createDataFrame([(1, "one two")], "doc_id long, text string").write.parquet(path)
    assert Bm25Index.stored(spark, path).corpus.first().n == 1
    spark.createDataFrame([(2, "three")], "doc_id long, text string").write.mode("append").parquet(path)
    assert Bm25Index.stored(spark, path).corpus.first().n == 2


def test_nearest_passes_over_null_and_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, None), (3, [0.0, 0.0]), (4, [1.0, 1.0, 1.0]), (5, [1.0, 1.0])]
    corpus = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    asked = spark.createDataFrame([(10, [1.0, 0.0]), (11, None), (12, [2.0, 2.0, 2.0])], "query_id long, embedding array<float>")
    got = [tuple(x) for x in vectors.nearest(asked, corpus, 2).orderBy("query_id", "rank").collect()]
    assert got == [(10, 1, 1.0, 1), (10, 5, 0.707107, 2), (12, 4, 1.0, 1)]
    assert vectors.nearest(asked.limit(0), corpus, 2).count() == 0


def test_parts_are_written_where_touched_only(spark, tmp_path):
    t = PartTable(spark, f"file://{tmp_path}/t", 16)
    assert t.read() is None
    t.upsert(spark.createDataFrame([(i, 1, f"a{i}") for i in range(200)], "id long, at int, v string"), "id", "at")
    before = {f: f.stat().st_mtime_ns for f in (tmp_path / "t").rglob("*.parquet")}
    batch = spark.createDataFrame([(3, 2, "b", 1.0), (999, 2, "new", None), (7, 0, "old", 2.0)], "id long, at int, v string, more double")
    for _ in range(2):  # a batch that comes again changes nothing
        t.upsert(batch, "id", "at")
        assert {x.id: (x.v, x.more) for x in t.read().collect()} == {i: (f"a{i}", None) for i in range(200)} | {3: ("b", 1.0), 999: ("new", None)}
    left = [f for f, at in before.items() if f.exists() and f.stat().st_mtime_ns == at]
    assert len(before) == 16 and len(left) >= 13


def test_state_of_a_stream_survives_a_failure_and_grows_by_its_changes(spark, tmp_path):
    from lexiflume.streaming import incremental

    schema, seen = "id long, at int, v string", []
    write = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = f"file://{tmp_path}/out"
    write([(i, 0, "x" * 50) for i in range(3000)])
    incremental.run_upserts(spark, stream(), out, "id", "at")
    size = lambda: sum(f.stat().st_size for f in (tmp_path / "out").rglob("*") if f.is_file())
    first = size()
    for n in range(1, 21):
        write([(n, n, f"v{n}"), (n, -1, "late"), (5000 + n, n, "new")])

    def fails(batch, n):
        seen.append((n, sorted(x.id for x in batch.collect())))
        if len(seen) == 8:
            raise RuntimeError("lost")

    with pytest.raises(Exception, match="lost"):
        incremental.run_upserts(spark, stream(), out, "id", "at", fails)
    incremental.run_upserts(spark, stream(), out, "id", "at", lambda batch, n: seen.append((n, sorted(x.id for x in batch.collect()))))
    assert len({n for n, _ in seen}) == 20 and sum(len(ids) for _, ids in dict(seen).items()) == 40
    want = {i: (0, "x" * 50) for i in range(3000)} | {n: (n, f"v{n}") for n in range(1, 21)} | {5000 + n: (n, "new") for n in range(1, 21)}
    assert {x.id: (x["at"], x.v) for x in incremental.current(spark, out).collect()} == want
    assert size() - first < 20 * first  # twenty batches together are no twenty copies of the state
    with pytest.raises(FileNotFoundError):
        incremental.current(spark, f"file://{tmp_path}/none")


def test_retry_waits_and_gives_up():
    waits, calls = [], []

    def call(prompt):
        calls.append(prompt)
        raise OSError("down")

    with pytest.raises(OSError, match="down"):
        generation.with_retry(call, 5, sleep=waits.append)("p")
    assert len(calls) == 5 and waits == [2, 4, 8, 15]


def test_errors_of_single_rows_are_data(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, text string")
    got = {x.id: (x.text, x.errors) for x in generation.chained(df, "text", [("base", None), ("up", str.upper), ("twice", lambda t: t + t)]).collect()}
    assert got[1] == ("AA", []) and got[3] == ("CC", []) and got[2][0] is None and [e.split(":")[0] for e in got[2][1]] == ["up", "twice"]


def test_packing_starts_a_batch_at_the_budget(spark):
    rows = spark.createDataFrame([("g", i, n) for i, n in enumerate([50, 40, 30, 500, 1, 99])] + [("h", 0, None)], "g string, i int, n int")
    got = [(x.g, x.batch) for x in chunking.pack_batches(rows, "g", "i", "n", 200).orderBy("g", "i").collect()]
    assert got == [("g", 0), ("g", 0), ("g", 1), ("g", 2), ("g", 3), ("g", 3), ("h", 0)]


def test_truncation_keeps_room_for_the_title(spark):
    df = spark.createDataFrame([("one, two  three", "a title"), ("x", "far too long a title"), (None, "t")], "text string, title string")
    assert [x[0] for x in df.select(chunking.truncated("text", "title", 4)).collect()] == ["one, two", "", ""]


def test_markdown_files_become_chunks(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.md").write_text("# Law\n## Chương I\n#### Điều 5. Scope\nkhoản 2 applies\n", encoding="utf-8")
    got = chunk_and_save(spark, f"file://{tmp_path}/in", f"file://{tmp_path}/out").collect()
    assert [(x.content, x.source, x.article, x.article_no, x.clause_nos) for x in got] == [("khoản 2 applies", "Law", "Điều 5. Scope", 5, [2])]


def test_import_refuses_repeated_keys(spark, tmp_path):
    folder = f"file://{tmp_path}"
    spark.createDataFrame([("1", "x"), ("1", "y")], "id string, text string").write.parquet(f"{folder}/text_units.parquet")
    with pytest.raises(ValueError, match="not unique"):
        GraphStore(spark, f"{folder}/graph").import_all(folder)


def test_report_without_cases(spark, tmp_path):
    r = ReportWriter(spark, f"file://{tmp_path}", "sig", "stamp", 3, ["a"])
    r.init()
    rows = read_report(spark, r.paths[1]).collect()
    assert sorted(x.kind for x in rows) == ["metadata", "summary"] and '"in_progress"' in rows[0].body
    r.append(spark.createDataFrame([(1, 0.5, 1, "p")], "id long, a double, at int, retrieved_payloads string"), "at")
    assert "retrieved_payloads" not in read_report(spark, r.finalize()[0]).where(F.col("kind") == "case").first().body
