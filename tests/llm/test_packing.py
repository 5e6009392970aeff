import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

from lexiflume.llm import numbering
from lexiflume.llm.packing import Encoder, best_fit_decreasing, pack

PATH = public_tokenizers.path("word_bpe_49k.json")


def whole(texts):
    t = Tokenizer.from_file(PATH)
    return [np.array(t.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in texts]


ODD = [
    None, "", " \n", "It's THE end's, isn't it?'s 'twas ''s .'s a.'s", "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|> <|x", "é, ≠ ́x, Å.", "İ, ŉ… “é,” — x–y", "ΣΑΣ Σ, ς",
    "a~b ~ ~~ x~", "1,234.56 £5 ½ x² 中文,字  x y \x1c z\x85q", "Å ﬁ ǆ,Ǆ", "a_b c'd e`f g^h [i] {j}|k| \\l\\ \"m\" n'", "é'é,'é '", "ª, µ. ×x ÷y", "x" * 5000 + "," * 300,
]


def test_ids_are_the_tokenizers():
    r = random.Random(4)
    chars = "abZ09éßÑ ,.'~!-_|<≯́İΣς中½ \n\tst"
    texts = ODD + ["".join(r.choice(chars) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    assert Encoder(PATH).encode(texts) == whole(texts)


def test_ids_of_the_tables():
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    assert Encoder(PATH).encode(texts) == whole(texts)


def test_memo_starts_afresh(monkeypatch):
    from lexiflume.llm import packing

    monkeypatch.setattr(packing, "MEMO", 5)
    e, texts = Encoder(PATH), ["a b c, d", "b, c. e f g", "h i j k l m n", "a b"]
    assert [e.encode([t])[0] for t in texts] == whole(texts)


@pytest.mark.parametrize("seed", range(8))
def test_best_fit_against_a_scan(seed):
    r, size = random.Random(seed), 100
    lengths = sorted((r.randint(1, 100 if seed % 2 else 30) for _ in range(400)), reverse=True)
    counts = Counter(lengths)
    places = best_fit_decreasing(counts, size)
    left = {}
    for n in sorted(counts, reverse=True):
        where, offsets = places[n](np.arange(counts[n]))
        for b, o in zip(where.tolist(), offsets.tolist(), strict=True):
            tight = min((c for c in left.values() if c >= n), default=None)
            if tight is None:
                assert b not in left and o == 0
                left[b] = size - n
            else:
                assert left[b] == tight and o == size - tight
                left[b] -= n


def test_places_do_not_grow_with_the_corpus():
    r = np.random.default_rng(2)
    few = {n: int(c) for n, c in enumerate(r.integers(1, 50, 2048), 1)}
    rows = [sum(len(p.start) for p in best_fit_decreasing({n: c * times for n, c in few.items()}, 2048).values()) for times in (1, 1000, 1_000_000)]
    assert max(rows) < 100_000 and rows[2] < 2 * rows[0]


@pytest.mark.parametrize("run", [2000, 20])
def test_pack(spark, monkeypatch, run):
    monkeypatch.setattr(numbering, "RUN", run)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["alpha", "Beta,", "gamma's", "x"]) for _ in range(r.randint(0, 90)))) for i in range(300)]
    rows += [(7, rows[7][1]), (None, "null id"), (900, None), (901, ""), (902, "word " * 500)]
    df = spark.createDataFrame([(i, t, 3) for i, t in rows], "doc_id long, text string, length int")
    out = pack(df, PATH, size=64, end_id=0).collect()
    ids = whole([t for _, t in rows])
    want = defaultdict(int)
    for (doc, _), x in zip(rows, ids, strict=True):
        x += bytes(4)
        for i, a in enumerate(range(0, len(x), 256)):
            want[doc, i, a // 4, len(x[a : a + 256]) // 4, zlib.crc32(x[a : a + 256])] += 1
    got = defaultdict(int)
    bins = defaultdict(list)
    for p in out:
        got[p.doc_id, p.piece, p.start, p.length, p.ids_crc32] += 1
        bins[p.sequence_id].append((p.offset, p.length))
    assert got == want
    for places in bins.values():
        at = 0
        for o, n in sorted(places):
            assert o == at
            at += n
        assert at <= 64
    plain = []
    for n in sorted((p.length for p in out), reverse=True):
        tight = min((c for c in plain if c >= n), default=64)
        if tight in plain:
            plain.remove(tight)
        plain.append(tight - n)
    assert sorted(64 - sum(n for _, n in x) for x in bins.values()) == sorted(plain)


def test_empty_table(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
