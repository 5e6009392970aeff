import heapq
import random
import zlib
from collections import defaultdict

from lexiflume.llm import numbering, sharding


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, shard int").repartition(4)


def corpus(n=500):
    r = random.Random(6)
    rows = [(i, "é" * r.choice([1, 5, 40, 300, 1000])) for i in range(n)]
    rows = [(i, t + str(r.randint(0, 300))) for i, t in rows]
    return rows + [(1, rows[1][1]), (None, "x"), (7000, None), (7001, "")] + [(8000 + i, "copy " * 40) for i in range(60)]


def check(rows, got, n):
    want = sorted(str((i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode()))) for i, t in rows)
    assert sorted(str((x.doc_id, x.size, x.text_crc32)) for x in got) == want
    shards, slots = defaultdict(set), defaultdict(list)
    for x in got:
        shards[x.grp].add(x.shard)
        slots[x.shard].append(x.slot)
        assert x.law == "bytes" and x.grown_shard is None and 0 <= x.shard < n
    assert all(len(s) == 1 for s in shards.values())
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def loads(got, n):
    out = [0] * n
    for x in got:
        out[x.shard] += x.size
    return out


def test_against_plain_scheduling(spark):
    rows = corpus()
    got = sharding.lpt_shards(frame(spark, rows), 7).collect()
    check(rows, got, 7)
    sizes = defaultdict(int)
    for x in got:
        sizes[x.grp] += x.size
    heap = [(0, s) for s in range(7)]
    for size in sorted(sizes.values(), reverse=True):
        load, s = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, s))
    assert sorted(loads(got, 7)) == sorted(x for x, _ in heap)


def test_sizes_are_dealt_as_by_a_plain_heap():
    r = random.Random(4)
    for _ in range(300):
        n = r.randint(1, 9)
        loads = [r.choice([0, r.randint(0, 500)]) for _ in range(n)]
        mine, plain = list(loads), [(x, s) for s, x in enumerate(loads)]
        heapq.heapify(plain)
        for size in sorted((r.randint(1, 90) for _ in range(r.randint(1, 5))), reverse=True):
            m, counts = r.choice([1, 5, 40, 400]), defaultdict(int)
            for _ in range(m):
                load, s = heapq.heappop(plain)
                counts[s] += 1
                heapq.heappush(plain, (load + size, s))
            got = sharding.deal(mine, size, m)
            assert {s: k for s, k in got.items() if k} == dict(counts)
        assert mine == [x for x, _ in sorted(plain, key=lambda p: p[1])]


def test_rounded_sizes_and_heavy_groups_keep_balance(spark, monkeypatch):
    for name, value in (("DIGITS", 6), ("HEAVY", 50)):
        monkeypatch.setattr(sharding, name, value)
    monkeypatch.setattr(numbering, "RUN", 10)
    rows = corpus(2000)
    got = sharding.lpt_shards(frame(spark, rows), 5).collect()
    check(rows, got, 5)
    assert max(loads(got, 5)) < 1.01 * sum(loads(got, 5)) / 5


def test_files_and_empty_table(spark, tmp_path):
    rows = corpus(60)
    sharding.write_shards(frame(spark, rows).drop("shard"), f"{tmp_path}/out", 4)
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(rows)
    assert sharding.lpt_shards(frame(spark, rows).limit(0)).count() == 0
