import hashlib
import re

from lexiflume.llm import pii

KINDS = ("email", "ip", "card", "phone")


def plain(text):
    """The fixed patterns, straight from their definition."""
    text, out = text or "", []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        twice = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        if 14 <= len(d) <= 19 and sum(twice) % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= sum(c.isdigit() for c in m[0]) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(a, b, KINDS[k]) for a, k, b in sorted(out)]


TEXTS = [
    None, "", "no data 12 4.0", "é a.b+c@x-y.co.uk, 1.2.3.4.5 300.1.1.1 0001.02.3.255", "4539 1488 0343 6467 and 4539-1488-0343-6468 41111111111111111111",
    "+1 (988) 555-2485 +12 +1234567890123456 x@y @z.com a@@b.c user@host.", "4539148803436467@mail.com +4539148803436467 10.0.0.1@x.y", "mail: a@b.cd\na@b.cd;e@f.gh.", "1-2-3-4 +0 0.0.0.0",
]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, base string").repartition(3)


def test_fixed_patterns(spark):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, TEXTS[4])]
    got = {(x.doc_id, x.base_sha256, x.n_email, x.n_ip, x.n_card, x.n_phone) for x in pii.find_pii(frame(spark, rows)).collect()}
    want = set()
    for i, t in rows:
        spans = plain(t)
        want.add((i, hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, b, k in spans).encode()).hexdigest(), *(sum(s[2] == k for s in spans) for k in KINDS)))
    assert got == want
    assert pii.find_pii(frame(spark, rows)).count() == len(rows)


def learnt():
    """Seeds stand between set words; unseen identifiers stand there too, other numbers elsewhere."""
    rows = [(i, f"filler words reach me under +1 (555) 555-{1000 + i} today or text {i}") for i in range(30)]
    rows += [(100 + i, f"also reach me under 0041-77-{12345 + i} today or not") for i in range(3)]
    return rows + [(200 + i, f"the parcel number 99887766{i}5 weighs less") for i in range(3)]


def test_contexts_discover_unseen_identifiers(spark):
    got = {x.doc_id: x for x in pii.find_pii(frame(spark, learnt())).collect()}
    for i in range(3):
        assert got[100 + i].spans == "id:20:33" and got[100 + i].n_found == 1
        assert got[200 + i].spans == ""
    assert all(got[i].n_phone == 1 and got[i].spans.startswith("phone:") for i in range(30))


def test_redaction_keeps_rows_and_columns(spark, monkeypatch):
    df = frame(spark, learnt() + [(900, None), (901, TEXTS[3]), (901, TEXTS[3])])
    for bound in (pii.BROADCAST_ROWS, 0):
        monkeypatch.setattr(pii, "BROADCAST_ROWS", bound)
        out = pii.redact(df)
        assert out.columns == df.columns
        got = {(x.doc_id, x.text) for x in out.collect()}
        assert out.count() == df.count()
        assert (100, "also reach me under [ID] today or not") in got and (900, None) in got
        assert (901, "é [EMAIL], [IP].5 300.1.1.1 [IP]") in got
        assert (200, "the parcel number 9988776605 weighs less") in got


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert pii.find_pii(df).count() == 0 and pii.redact(df).count() == 0


def test_scan_equals_the_definition_on_random_texts():
    import random

    r, token = random.Random(1), re.compile(r"[A-Za-z0-9][A-Za-z0-9_.:/@+-]*[0-9][A-Za-z0-9_.:/@+-]*")
    for _ in range(20_000):
        t = "".join(r.choice("ab1230..@@-+ ()é_=") for _ in range(r.randint(0, 60)))
        base = pii.base_spans(t)
        assert base == plain(t)
        want = [(m.start(), m.start() + len(m[0].rstrip("_.:/@+-"))) for m in token.finditer(t)]
        want = [(a, b) for a, b in want if pii._looks_like_id(t[a:b]) and not any(a < y and x < b for x, y, _ in base)]
        assert pii._identifiers(t, base) == want


def test_unbroken_runs_take_time_by_their_length():
    import time

    for t in ("1" * 10**6, "a" * 10**6 + " 1", "a@" * 500_000, "1.2.3.4." * 125_000 + "@x.y", "a=12345678," * 90_000, "+1" + "(" * 10**6):
        began = time.time()
        pii.occurrences(t, pii.base_spans(t))
        assert time.time() - began < 10


def test_a_found_identifier_supports_further_patterns(spark):
    """Seeds lead to identifiers of one place, those to identifiers of a place that no seed has been in."""
    rows = [(i, f"filler words reach me under +1 (555) 555-{1000 + i} today or text {i}") for i in range(30)]
    for i in range(6):
        rows += [(100 + i, f"also reach me under 0041-77-{12345 + i} today or not " * 3 + f"and our file keeps 0041-77-{12345 + i} secret")]
    rows += [(500 + i, f"his file keeps 0099-11-{77777 + i} secret") for i in range(2)] + [(600, "his parcel weighs 0099-11-88888 stones")]
    got = {x.doc_id: x.n_found for x in pii.find_pii(frame(spark, rows)).collect()}
    assert [got[i] for i in (*range(100, 106), 500, 501, 600)] == [4] * 6 + [1, 1, 0]


def test_clashing_columns_survive_redaction(spark):
    df = spark.createDataFrame([(1, "mail a@b.cd", 7, "m", 8)], "doc_id long, text string, rkey int, more string, RKEY_ int")
    out = pii.redact(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "mail [EMAIL]", 7, "m", 8)
