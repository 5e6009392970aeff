"""Steps whose work must not grow faster than their input."""

from pyspark.sql import functions as F

from lexiflume.functions import text as X
from lexiflume.operators import chunking


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_words_are_split_once_for_all_windows(spark):
    docs = spark.range(3).select(F.concat_ws(" ", F.array_repeat(F.col("id").cast("string"), 120)).alias("t"))
    assert _plan(docs.select(X.word_windows("t").alias("w"))).count("split(") == 1
    assert docs.select(F.size(X.word_windows("t")).alias("n")).distinct().first().n == 3


def test_tokens_are_found_once_for_all_windows(spark):
    docs = spark.range(3).select(F.concat_ws(" ", F.array_repeat(F.col("id").cast("string"), 120)).alias("t"))
    assert _plan(docs.select(chunking.windows(X.tokens("t"), 50, 40).alias("w"))).count("regexp_extract_all(") == 1
    assert docs.select(F.size(chunking.windows(X.tokens("t"), 50, 40)).alias("n")).distinct().first().n == 3


def test_vectors_within_tasks_give_the_chunks_of_joined_ones(spark):
    from lexiflume.operators.embedding import hashed_sums, hashed_vectors

    texts = [(i, "".join(f"w{i} w{j % 4} x{j * i % 5}. " + ("!?\n" if j % 3 == 0 else "... ") for j in range(i * 7))) for i in range(12)]
    docs = spark.createDataFrame([*texts, (99, None)], "doc_id long, text string").repartition(3)
    inside = chunking.semantic_chunks(docs, rows=lambda words: hashed_sums(words)[0])
    assert "embedding" not in _plan(inside)  # no vector is shuffled
    assert sorted(map(tuple, inside.collect())) == sorted(map(tuple, chunking.semantic_chunks(docs, hashed_vectors).collect()))


def test_cells_of_a_text_are_added_up_before_the_shuffle(spark):
    from lexiflume.operators.embedding import hashed_cells

    docs = spark.createDataFrame([(1, "one two two"), (1, "one"), (2, None), (3, "")], "id long, text string")
    cells = hashed_cells(docs)
    assert "Generate" not in _plan(cells)
    assert sorted(abs(r.value) for r in cells.collect()) == [2, 2] and {r.id for r in cells.collect()} == {1}


def test_pairs_of_words_are_shuffled_once_as_hashes(spark):
    from lexiflume.operators.entities import entities

    docs = spark.createDataFrame([(i, f"Red Fox r{i} blue fox s{i}") for i in range(40)], "doc_id long, text string")
    found = entities(docs)
    assert _plan(found).count("Generate ") == 1
    assert sorted((r.name, r.kind, r.n) for r in found.collect()) == [("blue fox", "term", 40), ("red fox", "name", 40)]


def test_scores_are_rounded_before_they_are_sorted(spark):
    from lexiflume.plans.retrieval_queries import w01

    assert not any("round(" in line for line in _plan(w01(spark, "/root/testdata/sf0.001")).splitlines() if "Window" in line)


def test_few_texts_of_a_batch_are_strings_at_once(spark, monkeypatch):
    from lexiflume.operators import generation

    monkeypatch.setattr(generation, "AT_ONCE", 2)

    def call(t):
        if t == "3":
            raise ValueError("three")
        return t + "!"

    df = spark.range(0, 7, 1, 1).select(F.col("id").cast("string").alias("t")).select("t", generation.attempted("t", call).alias("r"))
    assert "ArrowEvalPython" in _plan(df)
    assert [(r.r.value, r.r.error) for r in df.collect()] == [(None, "three") if i == 3 else (f"{i}!", None) for i in range(7)]


def test_a_store_of_several_parts_is_one_file(spark, tmp_path):
    from lexiflume.sources import store

    c = store.Catalog()
    spark.range(9).repartition(3).write.parquet(f"{tmp_path}/embeddings.parquet")
    for name in ("entities", "relations"):
        spark.range(2).repartition(2).write.parquet(f"{tmp_path}/graph/{name}.parquet")
    c.open(spark, "vector", f"file://{tmp_path}/embeddings.parquet")
    c.register("graph", spark.read.parquet(*(f"file://{tmp_path}/graph/{n}.parquet" for n in ("entities", "relations"))))
    assert sorted(map(tuple, c.status(spark).collect())) == [("graph", True, 2, 4), ("vector", True, 1, 9)]


def test_token_vectors_are_pooled_in_the_task_of_their_batch(spark):
    import numpy as np

    from lexiflume.operators import vectors

    sizes = [3, 0, 5, 20_000, 7, None, 4, 1]
    rows = [(f"c{g}-{i}", f"s{g}", i, n) for g in range(3) for i, n in enumerate(sizes * (g + 1))]
    chunks = spark.createDataFrame(rows, "chunk_id string, source string, doc_id long, n_tokens long").repartition(3)

    def joined(packed):
        places = packed.where("n_tokens > 0").select("batch_id", "start", "n_tokens", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_tokens") - 1)).alias("j"))
        return places.select(F.col("batch_id").alias("doc_id"), (F.col("start") + F.col("j")).alias("pos"), F.array(F.col("n_tokens") / 2 + 1, (F.col("start") + F.col("j") + 1).cast("double")).alias("embedding"))

    def inside(part, first, last):
        n, pos = np.array([x or 0 for x in part.column("n_tokens").to_pylist()]), np.arange(first, last)
        return np.stack([n[np.searchsorted(np.cumsum(n), pos, "right")] / 2 + 1, pos + 1.0], 1)

    here = vectors.late_ingest(chunks, rows=inside, budget=130)
    assert "Generate" not in _plan(here)  # no row for each token
    found = lambda df: sorted((r.chunk_id, r.batch_id, r.start, r.end, [round(x, 9) for x in r.embedding]) for r in df.collect())
    assert found(here) == found(vectors.late_ingest(chunks, joined, budget=130))
    assert len(found(here)) == 6 * 6
    nothing = vectors.late_ingest(chunks.where("n_tokens is null or n_tokens = 0"), rows=inside)
    assert nothing.count() == 0


def test_r20_makes_no_row_for_each_token(spark):
    from lexiflume.plans.service_queries import r20

    assert "Generate" not in _plan(r20(spark, "/root/testdata/sf0.001"))


def test_an_index_splits_texts_once(spark, tmp_path):
    from lexiflume.operators.bm25 import Bm25Index

    texts = ["b a a é", None, "", "c,b;b A", "?!", "ß b", "x" * 70_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    index = Bm25Index.build(docs, slice_docs=2)
    index.save(f"file://{tmp_path}/index")
    stored = Bm25Index.load(spark, f"file://{tmp_path}/index")
    assert "regexp_extract_all" not in Bm25Index.of(stored.slices, 0.25).terms._jdf.queryExecution().optimizedPlan().toString()
    want = {"a": 2, "b": 3, "c": 1, "é": 1, "ß": 1, "x" * 70_000: 1}
    for found in (index, stored):
        assert {r.term: r.df for r in found.terms.collect()} == want
        assert found.corpus.first() == (7, 11 / 7)
    read = stored.search(spark.createDataFrame([(1, "b")], "query_id long, query string"))._jdf.queryExecution().sparkPlan().toString()
    columns = [line.split("FileScan parquet [")[1].split("]")[0] for line in read.splitlines() if "FileScan" in line]
    assert any("tfs#" in c for c in columns) and not any("words#" in c for c in columns)  # a search does not read them
    keys = {r.term: r.key for r in stored.terms.select("term", "key").collect()}
    assert {r.k for r in stored.slices.select(F.explode("terms").alias("k")).collect()} == set(keys.values())
    assert sorted(map(tuple, stored.postings.collect())) == sorted(map(tuple, index.postings.collect()))
    assert (("b", 3, 2) in set(map(tuple, stored.postings.collect()))) and (("a", 0, 2) in set(map(tuple, stored.postings.collect())))
