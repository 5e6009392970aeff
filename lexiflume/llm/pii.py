"""Personal data: fixed patterns, then bootstrapped contextual extraction.

Seeds are the fixed patterns' finds. The words around each identifier-like token (many digits, or many letters and
digits mixed) are its lexical patterns. Spark scores the graph of patterns and instances in rounds: a pattern is as good as the
instances it has met, an instance as good as the patterns it has been met in; seeds stay at 1. Instances above the
threshold, met in at least two patterns that are themselves good and have seen several supporters, are new identifiers; they
support patterns in the next round, until a round finds nothing new.

Counts and scores cover all documents. Null and empty texts have no spans. Repeated rows give repeated result rows and
count once in the graph. A null doc_id is a value like another; an empty table gives no rows; columns other than id and text are
ignored by the search and kept by the redaction, whatever their names. Time grows with a text's length, also within one unbroken run.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.scratch import Scratch, unused

KINDS = ("email", "ip", "card", "phone", "id")
ROUNDS, ACCEPT, MIN_SEEDS, DOUBT = 3, 0.5, 3, 2.0
#: Rows of found spans that may be broadcast to the redaction; more are joined by a shuffle.
BROADCAST_ROWS = 200_000

# The fixed patterns, cut so that no start is tried twice: an address around each @, whole chains of numbers, and the rest as given.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]*+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_CHAIN = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: A token that may be an identifier lies in a run of letters, digits and inner marks with at least one digit.
_RUN = re.compile(r"[A-Za-z0-9_.:/@+-]*+")
_MARKS = "_.:/@+-"
_NEAR = re.compile(r"[^\x20\x09-\x0D]++")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int, str]]:
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        run, domain = _LOCAL.match(text[free:at][::-1]).end(), _DOMAIN.match(text, at + 1)
        if run and domain:
            found.append((at - run, domain.end(), "email"))
        free = domain.end() if run and domain else at + 1
        at = text.find("@", free)
    return found


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind in the order of KINDS."""
    if not text:
        return []
    found = _emails(text)
    if _DIGIT.search(text):
        for m in _CHAIN.finditer(text):
            parts = m[0].split(".")
            at = m.start()
            for i in range(0, len(parts) - 3, 4):
                four = parts[i : i + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                    found.append((at, end, "ip"))
                at = end + 1
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), "card"))
        for m in _PHONE.finditer(text):
            if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                found.append((*m.span(), "phone"))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def _hash(*words: str) -> int:
    return xxhash.xxh3_64_intdigest("\0".join(words).encode("utf-8", "surrogatepass")) - 2**63


def _looks_like_id(token: str) -> bool:
    digits = sum(c.isdigit() for c in token)
    return len(token) >= 8 and digits >= 4 and (2 * digits >= len(token) or len(token) >= 12)


def _identifiers(text: str, taken: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Identifier-like tokens that touch no span already taken."""
    found, free, ends, starts = [], 0, [], []
    for a, b, _ in sorted(taken):  # merged
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    digit = _DIGIT.search(text)
    while digit:
        at = digit.start()
        start, free = at - _RUN.match(text[free:at][::-1]).end(), _RUN.match(text, at).end()
        token = text[start:free].lstrip(_MARKS)
        start, end = free - len(token), free - len(token) + len(token.rstrip(_MARKS))
        i = bisect_right(ends, start)
        # A key before the value (key=value) is context, not part of the identifier; runs have no '='.
        if _looks_like_id(text[start:end]) and _DIGIT.search(text, start + 1, end) and not (i < len(starts) and starts[i] < end):
            found.append((start, end))
        digit = _DIGIT.search(text, free)
    return found


def occurrences(text: str | None, base: list[tuple[int, int, str]]) -> list[dict]:
    """Seeds and identifier-like tokens outside them, with their lexical patterns: the word before, the word after, both, the
    two words before. Neighbouring words are looked for up to the next span on that side."""
    if not text or not (base or _DIGIT.search(text)):
        return []
    spans = sorted([*((s, e, _hash("seed", k, text[s:e].lower()), True) for s, e, k in base), *((s, e, _hash("id", text[s:e].lower()), False) for s, e in _identifiers(text, base))])
    starts, out, last = [s for s, *_ in spans], [], (0, 0)
    for s, e, inst, seed in spans:
        before = text[last[1] if last[1] <= s else last[0] : s].lower().rsplit(None, 2)[-2:]
        last = s, e
        i = bisect_left(starts, e)
        after = _NEAR.search(text, e, starts[i] if i < len(starts) else len(text))
        left, right = (before or ["^"])[-1], after[0].lower() if after else "$"
        left2 = before[0] if len(before) == 2 else "^"
        out.append({"start": s, "end": e, "inst": inst, "seed": seed, "pats": [_hash("l", left), _hash("r", right), _hash("lr", left, right), _hash("ll", left2, left)]})
    return out


_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())])
_OCC = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("inst", pa.int64()), ("seed", pa.bool_()), ("pats", pa.list_(pa.int64()))])
_SCHEMA = "doc_id long, rkey long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, base array<struct<start:long,end:long,kind:string>>, occ array<struct<start:long,end:long,inst:long,seed:boolean,pats:array<long>>>"


def joined(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def _scan(batches):
    for batch in batches:
        texts = batch.column("text").to_pylist()
        base = [base_spans(t) for t in texts]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                batch.column("rkey"),
                *(pa.array([sum(s[2] == k for s in b) for b in base], pa.int64()) for k in KINDS[:4]),
                pa.array([hashlib.sha256(joined(b).encode()).hexdigest() for b in base]),
                pa.array([[dict(zip(("start", "end", "kind"), s, strict=True)) for s in b] for b in base], pa.list_(_SPAN)),
                pa.array([occurrences(t, b) for t, b in zip(texts, base, strict=True)], pa.list_(_OCC)),
            ],
            ["doc_id", "rkey", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base", "occ"],
        )


def graph_scores(occ: DataFrame, scratch: Scratch, rounds: int = ROUNDS) -> DataFrame:
    """occ (inst, seed, pats), one row per occurrence. Returns inst and score of new instances to accept, after ``rounds`` rounds
    at least and as many as find new ones."""
    edges = scratch.keep("edges", occ.select("inst", "seed", F.explode("pats").alias("pat")).groupBy("pat", "inst").agg(F.count("*").alias("n"), F.max("seed").alias("seed")))
    score = edges.select("inst", "seed").distinct().select("inst", F.col("seed").cast("double").alias("conf"), F.col("seed").alias("sure"))
    done, i, accepted = False, 0, 0
    while not done:
        # DOUBT stands for unseen occurrences that were no identifiers, so rare patterns start low.
        pats = edges.join(score, "inst").groupBy("pat").agg((F.sum(F.col("n") * F.col("conf")) / (F.sum("n") + DOUBT)).alias("good"), F.count(F.when(F.col("sure"), 1)).alias("support"))
        pats = scratch.keep(f"pats-{i}", pats)
        met = edges.join(pats, "pat").groupBy("inst", "seed").agg(
            (F.sum(F.col("n") * F.col("good")) / F.sum("n")).alias("mean"),
            F.count(F.when((F.col("good") >= ACCEPT) & (F.col("support") >= MIN_SEEDS), 1)).alias("strong"),
        )
        new = (F.col("mean") >= ACCEPT) & (F.col("strong") >= 2)
        before = score.select("inst", F.col("sure").alias("was"))  # once accepted, an instance counts as a seed does
        now = met.join(before, "inst").select("inst", "seed", "mean", (F.col("was") | new).alias("sure"))
        score = scratch.keep(f"score-{i}", now.withColumn("conf", F.when(F.col("sure"), 1.0).otherwise(F.col("mean"))))
        scratch.drop(f"pats-{i}", *([f"score-{i - 1}"] if i else []))
        last, accepted = accepted, score.where("sure and not seed").count()
        score, whole, i = score.select("inst", "conf", "sure"), score, i + 1
        done = i >= rounds and accepted == last
    found = scratch.keep("found", whole.where("sure and not seed").select("inst", F.col("mean").alias("score")))
    scratch.drop("edges", f"score-{i - 1}")
    return found


def _keyed(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("rkey"))


def _found(scanned: DataFrame, scratch: Scratch) -> DataFrame:
    """rkey, more: spans of new identifiers of each row that has some."""
    occ = scanned.where(F.size("occ") > 0).select("rkey", "occ").dropDuplicates(["rkey"]).select("rkey", F.explode("occ").alias("o")).select("rkey", "o.*")
    occ = scratch.keep("occ", occ)
    good = graph_scores(occ.select("inst", "seed", "pats"), scratch)
    new = occ.where("not seed").join(good.select("inst"), "inst", "left_semi")
    return new.groupBy("rkey").agg(F.collect_set(F.struct("start", "end", F.lit("id").alias("kind"))).alias("more"))


def find_pii(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """One row per document: doc_id, counts and digest of the fixed patterns' spans, and all spans (string
    kind:start:end by start; n_found of them are new identifiers, of kind id)."""
    scratch = scratch or Scratch(documents.sparkSession)
    scanned = scratch.keep("scanned", _keyed(documents, id_col, text_col).mapInArrow(_scan, _SCHEMA))
    more = scratch.keep("more", _found(scanned, scratch))
    scratch.drop("occ")
    order = F.expr("""array_sort(concat(base, coalesce(more, array())), (l, r) -> case
        when l.start <> r.start then cast(l.start - r.start as int)
        else cast(array_position(array('email', 'ip', 'card', 'phone', 'id'), l.kind) - array_position(array('email', 'ip', 'card', 'phone', 'id'), r.kind) as int) end)""")
    all_spans = scanned.select("doc_id", "rkey", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "base").join(more, "rkey", "left").withColumn("list", order)
    return all_spans.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", F.expr("array_join(transform(list, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')").alias("spans"), F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"))


def redact(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The same rows and columns with each span's text replaced by its kind in square brackets; null texts stay."""
    scratch = scratch or Scratch(documents.sparkSession)
    keyed = _keyed(documents, id_col, text_col)
    scanned = scratch.keep("scanned", keyed.mapInArrow(_scan, _SCHEMA).where(F.size("occ") > 0))
    more = scratch.keep("more", _found(scanned, scratch))
    scratch.drop("occ", "scanned")
    key = unused("rkey", documents.columns)
    more = more.toDF(key, unused("more", documents.columns))
    at = documents.columns.index(text_col)
    wide = documents.withColumn(key, F.xxhash64(F.col(id_col).cast("long"), text_col))
    wide = wide.join(F.broadcast(more) if more.count() <= BROADCAST_ROWS else more, key, "left").drop(key)

    def cut(batches):
        for batch in batches:
            texts = []
            for text, more in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True):
                end, parts = 0, []
                for a, b, kind in sorted([*base_spans(text), *((s["start"], s["end"], s["kind"]) for s in more or [])]):
                    if a >= end:
                        parts += [text[end:a], f"[{kind.upper()}]"]
                    end = max(end, b)
                texts.append("".join([*parts, text[end:]]) if parts else text)
            columns = [pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names[:-1])

    return wide.mapInArrow(cut, documents.schema)
