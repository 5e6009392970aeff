"""A stored index is read a few slices at a time."""

import glob

import pyarrow.parquet as pq

from lexiflume.operators.bm25 import Bm25Index


def test_row_groups_hold_few_slices(spark, tmp_path):
    docs = spark.range(10, numPartitions=1).selectExpr("id as doc_id", "repeat(concat('w', id, ' '), cast(id + 1 as int)) as text")
    Bm25Index.build(docs, slice_docs=1).save(f"{tmp_path}/index")
    files = [pq.ParquetFile(f).metadata for f in glob.glob(f"{tmp_path}/index/slices/*.parquet")]
    groups = [m.row_group(i).num_rows for m in files for i in range(m.num_row_groups)]
    assert sum(groups) == 10 and max(groups) <= 4
    assert [tuple(r) for r in Bm25Index.load(spark, f"{tmp_path}/index").corpus.collect()] == [(10, 5.5)]


def test_corpus_of_no_documents(spark, tmp_path):
    Bm25Index.build(spark.createDataFrame([], "doc_id long, text string")).save(f"{tmp_path}/index")
    assert [tuple(r) for r in Bm25Index.load(spark, f"{tmp_path}/index").corpus.collect()] == [(0, 0.0)]
