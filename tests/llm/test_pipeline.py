import random
from collections import defaultdict

import corpus_pipeline as cp
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from lexiflume.llm import pii
from tests.llm.test_decontamination import brute as leaks
from tests.llm.test_jaccard_join import brute as components
from tests.llm.test_quality import plain as counts


def tables(path, spark):
    r = random.Random(8)
    words = [f"word{i}" for i in range(300)]
    prose = lambda n: [r.choice(words) for _ in range(n)]
    items = [(i, " ".join(prose(30))) for i in range(6)]
    docs = []
    for i in range(150):
        w = prose(r.randint(60, 120))
        if i % 10 == 1:
            w = docs[-1][1].split()  # a near copy
            w[3] = "changed"
        if i % 15 == 0:
            w[20:20] = items[i % 6][1].upper().split()
        if i % 7 == 0:
            w[5:5] = ["mail", f"a{i}@b.org"]
        if i % 11 == 0:
            w = [x + "$$$" for x in w]
        docs.append((i, " ".join(w), "en", "s", 1))
    docs += [(900, None, "en", "s", 0), (901, "", None, "s", None), (902, "short one", "en", None, 9), docs[2]]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 11 != 0)) for i in range(120)], "doc_id long, quality int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return docs, items


def test_stages_against_brute_force(spark, tmp_path):
    docs, items = tables(str(tmp_path), spark)
    docs_in = spark.read.parquet(f"{tmp_path}/documents.parquet")
    one = cp.quality(spark, docs_in, str(tmp_path))
    assert one.schema == docs_in.schema
    kept = sorted(map(tuple, one.collect()))
    # The fixed rules reject short texts; the labels mark texts full of symbols, all others are clean.
    assert kept == sorted(d for d in docs if counts(d[1])[0] >= 50 and d[0] % 11 != 0)

    two = cp.near_duplicates(spark, one, str(tmp_path))
    parts = components([d[:2] for d in kept], 5, 80)
    first = {c for _, _, c in parts}
    left = sorted({d for d in kept if d[0] in first})
    assert sorted(map(tuple, two.collect())) == left and len(left) < len(kept)

    three = cp.decontaminate(spark, two, str(tmp_path))
    dirty = {x[0] for x in leaks([d[:2] for d in left], items)}
    clean = [d for d in left if d[0] not in dirty]
    assert sorted(map(tuple, three.collect())) == clean and dirty

    four = cp.redact(spark, three, str(tmp_path))
    assert four.columns == docs_in.columns
    want = {}
    for i, t, *_ in clean:
        for a, b, k in reversed(pii.base_spans(t)):
            t = t[:a] + f"[{k.upper()}]" + t[b:]
        want[i] = t
    assert {x.doc_id: x.text for x in four.collect()} == want
    assert all(x.n_chars == len(x.text) for x in four.collect())

    five = cp.pack(spark, four, str(tmp_path)).collect()
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    lengths = defaultdict(int)
    for x in five:
        lengths[x.doc_id] += x.length
    assert lengths == {i: len(t.encode(x, add_special_tokens=False).ids) + 1 for i, x in want.items()}
    assert sorted(map(tuple, cp.run(spark, str(tmp_path)).select("doc_id", "piece", "length", "ids_crc32").collect())) == sorted((x.doc_id, x.piece, x.length, x.ids_crc32) for x in five)


def test_rows_without_words_stay_in_the_join(spark):
    df = spark.createDataFrame([(1, None, "a", "b", 0), (1, None, "a", "b", 0), (2, "", "a", "b", 0), (None, "x y z", "a", "b", 0), (None, "x y z", "a", "b", 0), (3, "x y z", "a", "b", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(map(str, (tuple(x)[:2] for x in cp.near_duplicates(spark, df, "").collect()))) == sorted(map(str, [(1, None), (2, ""), (3, "x y z")]))
    assert cp.near_duplicates(spark, df.limit(0), "").count() == 0
