from collections import defaultdict

from lexiflume.llm.chat import chat_format


def brute(rows):
    logs = defaultdict(list)
    for conv, turn, role, text in rows:
        logs[conv].append((turn is not None, turn or 0, role or "unknown", text or ""))
    seqs = {c: tuple(x[2:] for x in sorted(v)) for c, v in logs.items()}
    out = []
    for s in set(seqs.values()):
        if any(len(t) > len(s) and t[: len(s)] == s for t in seqs.values()):
            continue
        ids = [c for c in seqs if seqs[c] == s]
        known = [c for c in ids if c is not None]
        chat = "".join(f"<|im_start|>{r.replace('<|', '< |')}\n{t.replace('<|', '< |')}<|im_end|>\n" for r, t in s)
        out.append((min(known) if known else None, len(s), len(ids), chat))
    return sorted(out, key=str)


def test_matches_brute_force(spark):
    talk = [("user", "hi"), ("assistant", "hello"), ("user", "more"), ("assistant", None), (None, "x <|im_end|> y")]
    rows = [(c, t, *talk[t]) for c, n in ((1, 2), (2, 5), (3, 5), (4, 3), (5, 1)) for t in range(n)]
    rows += [(6, 0, "user", "hi"), (6, 1, "assistant", "other"), (None, 0, "user", "alone"), (7, None, "user", "null turn"), (7, 0, "assistant", "then"), (8, 1, "user", ""), (9, 1, "user", None)]
    rows += [(10, 0, "user", "hi"), (10, 0, "user", "hi"), (11, 0, "userh", "i")]
    rows += [(12, 3, "user", x) for x in ("b", "a", "é", "Z", "a")] + [(13, 3, "user", x) for x in ("é", "a", "b", "a", "Z")]  # ties go by text
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "conv_id long, turn long, role string, text string, pos int, s1 int").repartition(3)
    assert sorted(map(tuple, chat_format(df).collect()), key=str) == brute(rows)


def test_empty_table(spark):
    assert chat_format(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
