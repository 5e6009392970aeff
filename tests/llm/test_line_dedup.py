import hashlib
import random
from collections import defaultdict

from pyspark.sql import functions as F

from lexiflume.llm import line_dedup, lookup
from lexiflume.llm.line_dedup import dedup_lines

BLANK = " \t\n\x0b\x0c\r"


def key(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(BLANK))


def brute(rows, min_chars=20, min_docs=3):
    """doc_id, text, n_lines, n_dropped of each row; a null id is below all others."""
    order = lambda i: (i is not None, i or 0)
    held = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            held[key(line)].add(order(i))
    gone = {k: max(s) for k, s in held.items() if len(k) >= min_chars and len(s) >= min_docs}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in gone or gone[key(x)] == order(i)]
        out.append((i, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


def corpus(seed=3, n=120):
    r = random.Random(seed)
    shared = ["A line that many documents hold", "  another LINE that Many hold\t", "short", "", " no blank of ours at its ends ", "zwanzig Zeichen äöü ß", "NINETEEN characters", "exactly 20 characte"]
    rows = []
    for i in range(n):
        lines = [r.choice(shared) if r.random() < 0.6 else f"line {r.randint(0, 150)} of the rest of the texts" for _ in range(r.randint(1, 9))]
        rows.append((i, "\n".join(x.upper() if r.random() < 0.2 and x.isascii() else x for x in lines)))
    return rows


def run(spark, rows, **kw):
    df = spark.createDataFrame([(i, t, 5, "x", 1.5) for i, t in rows], "doc_id long, text string, N_Lines int, h1 string, line_doc double").repartition(5)
    out = dedup_lines(df, **kw)
    assert out.columns == ["doc_id", "text", "h1", "line_doc", "n_lines", "n_dropped"]
    return sorted(((x.doc_id, x.text, x.n_lines, x.n_dropped) for x in out.collect()), key=str)


def test_matches_brute_force(spark):
    rows = corpus()
    rows += [(500, None), (501, ""), (502, "\n\n"), (503, "a line that many documents hold\r\n" * 3), (504, "x\n" * 5000 + "A line that many documents hold"), (505, "A line that many documents hold " * 9000)]
    rows += [(7, rows[7][1]), (7, "A line that many documents hold\nonly here, in a second row of one document"), (None, "A line that many documents hold\nand this"), (None, "A line that many documents hold\nand that")]
    rows += [(None, "three rows without an id are one document"), (None, "three rows without an id are one document\n1"), (None, "three rows without an id are one document\n2")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows, min_chars=4, min_docs=2) == brute(rows, 4, 2)


def test_a_line_of_most_documents(spark, monkeypatch):
    """With a low bound several keys are looked up by a broadcast, others by a shuffle."""
    monkeypatch.setattr(lookup, "HEAVY", 20)
    rows = corpus(8, 200)
    assert run(spark, rows) == brute(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    lines = df.select(F.col("doc_id"), F.xxhash64("text").alias("text_hash"), "text").mapInArrow(line_dedup._keyed_lines(20), "doc_id long, text_hash long, pos int, h1 long, h2 long")
    sizes = [x.n for x in line_dedup.common_lines(lines).collect()]
    assert any(n * 20 > lines.count() for n in sizes) and any(n * 20 <= lines.count() for n in sizes)


def test_query_gives_digests_and_empty_tables_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert dedup_lines(df).count() == 0
    rows = corpus(4, 30)
    got = dedup_lines(spark.createDataFrame(rows, df.schema)).select(F.sha2("text", 256).alias("s")).collect()
    assert sorted(x.s for x in got) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t, _, _ in brute(rows))
