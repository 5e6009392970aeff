import math
import random
from collections import defaultdict
from datetime import datetime, timedelta

from lexiflume.llm import golden_record
from lexiflume.llm.golden_record import golden_records

BLANK = " \t\n\x0b\x0c\r"
COLUMNS = "client_id long, master_id long, source string, updated_at timestamp_ntz, name string, email string, city string, nation_id int, segment string, balance double"
TRUST = {"partner": 4, "store": 3, "web": 2, "crm": 1}


def up(x):
    """Ascending, nulls last."""
    return (x is None, x if x is not None else 0)


def best(records, order):
    return min(records, key=order) if records else None


def brute(rows):
    groups = defaultdict(list)
    for client, master, source, at, name, email, city, nation, segment, balance in rows:
        name, email, city, segment = (None if x is None or not x.strip(BLANK) else x for x in (name, email, city, segment))
        cents = None if balance is None or not math.isfinite(balance) or abs(100 * balance + 0.5) >= 2**63 else math.floor(100 * balance + 0.5)
        groups[client if master is None else master].append({"id": client, "trust": TRUST.get(source, 0), "at": at, "name": name, "email": email, "city": city, "nation": nation, "segment": segment, "cents": cents})
    out = []
    for cluster, records in groups.items():
        latest = max((r["at"] for r in records if r["at"]), default=None)
        late = lambda at: (latest - at) / timedelta(microseconds=1) if at else math.inf
        for r in records:
            r["stale"] = r["at"] is None or latest - r["at"] > timedelta(days=30)
            r["recent"] = (late(r["at"]), -r["trust"], up(r["id"]))
            r["trusted"] = (r["stale"], -r["trust"], *r["recent"])
        text = lambda x: x.encode()
        segment = best([r for r in records if r["segment"]], lambda r: (r["recent"], text(r["segment"])))
        email = best([r for r in records if r["email"]], lambda r: (r["trusted"], text(r["email"])))
        name = best([r for r in records if r["name"]], lambda r: (-len(r["name"]), r["trusted"], text(r["name"])))
        chosen = segment and segment["segment"]
        balance = best([r for r in records if r["cents"] is not None], lambda r: (not (chosen is not None and r["segment"] == chosen), r["recent"], r["cents"]))
        address = best(records, lambda r: (-(r["city"] is not None) - (r["nation"] is not None), r["trusted"], (r["city"] is None, text(r["city"] or "")), up(r["nation"])))
        get = lambda r, k: r and r[k]
        some = address["city"] is not None or address["nation"] is not None
        out.append((cluster, len(records), sum(r["stale"] for r in records), get(name, "name"), get(email, "email"), chosen, address["city"], address["nation"], get(balance, "cents"), get(name, "id"), get(email, "id"), get(segment, "id"), get(balance, "id"), address["id"] if some else None))
    return sorted(out, key=str)


def clients(seed, n, hot=0.4):
    r = random.Random(seed)
    start = datetime(2024, 1, 1)
    rows = []
    for i in range(n):
        master = r.choice([None, 5 if r.random() < hot else r.randint(0, n // 4), i])
        at = None if r.random() < 0.1 else start + timedelta(days=r.randint(0, 60), microseconds=r.choice([0, 0, 0, 1]))
        rows.append(
            (i, master, r.choice(["partner", "store", "web", "crm", None, "other", "WEB"]), at, r.choice([None, "", " \t", "Ann", "Ann B", "Änn", "ÄnnB C"]), r.choice([None, "\x0b", "a@b.c", "d@e.f "]),
             r.choice([None, "", "Rome", "Oslo"]), r.choice([None, 1, 2]), r.choice([None, "", "retail", "public", "online"]), r.choice([None, 1.005, -0.005, 10.0, r.uniform(-9, 9)]))
        )
    return rows


def run(spark, rows):
    df = spark.createDataFrame([(*r, "clash", 3) for r in rows], COLUMNS + ", cluster_id string, cell int").repartition(4)
    return sorted(map(tuple, golden_records(df).collect()), key=str)


def test_matches_brute_force(spark):
    rows = clients(1, 700)
    rows += [rows[3], rows[3], (None, None, "web", None, "x", None, None, None, None, 1.0), (None, None, "crm", datetime(2024, 1, 1), None, "", " ", None, "s", None), (None, 5, "partner", None, "no id" * 4000, None, None, None, None, None)]
    rows += [(9000, None, "store", None, None, None, None, None, None, float("nan")), (9001, None, "store", None, "", "", "", None, "", float("inf")), (9002, None, "store", None, None, None, None, None, None, 1e300)]
    assert run(spark, rows) == brute(rows)


def test_stale_to_the_microsecond_and_ties(spark):
    last = datetime(2024, 3, 31, 12)
    old = last - timedelta(days=30)
    rows = [
        (1, 1, "web", last, "w", "w@x", None, None, "a", 1.0), (2, 1, "partner", old, "p", "p@x", None, None, None, None), (3, 1, "partner", old - timedelta(microseconds=1), "q", "q@x", None, 7, "b", 2.0),
        (5, 2, "web", last, "same", "one@x", "A", 1, "a", 3.0), (5, 2, "web", last, "SAME", "two@x", "B", 1, "b", 4.0), (4, 2, "web", None, None, None, None, None, None, 5.0),
    ]
    got = run(spark, rows)
    assert got == brute(rows)
    assert [(x[2], x[4]) for x in got] == [(1, "p@x"), (1, "one@x")]


def test_one_cluster_in_pieces_and_empty_table(spark):
    rows = clients(2, 900, hot=1.0)
    rows = [(r[0], 5, *r[2:]) for r in rows]
    assert run(spark, rows) == brute(rows)
    assert golden_records(spark.createDataFrame([], COLUMNS)).count() == 0
    assert golden_record.TRUST == tuple(sorted(TRUST, key=TRUST.get, reverse=True))
