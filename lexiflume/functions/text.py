"""Text functions as Column expressions: tokenisers, legal numbers and references, splitting, cleaning."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, functions as F
from pyspark.sql.types import StringType

# A letter, digit or underscore; the keywords before legal numbers; Roman digits.
WORD = r"[\p{L}\p{N}_]"
EDGE = rf"(?:^|[^\p{{L}}\p{{N}}_])"
ARTICLE, CHAPTER, SECTION, CLAUSE = "(?:điều|article)", "(?:chương|chapter)", "(?:mục|section)", "(?:khoản|clause)"
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


@F.pandas_udf(StringType())
def nfc(s: pd.Series) -> pd.Series:
    """Unicode composition: Spark has no built-in for it."""
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFC", x))


def collapse(c: Column | str) -> Column:
    """White space runs become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " "))


def normalize(c: Column | str, lower: bool = True) -> Column:
    """Composed, collapsed, lower-cased."""
    out = collapse(nfc(_col(c)))
    return F.lower(out) if lower else out


def eval_normalize(c: Column | str) -> Column:
    """Lower-cased words with all other marks as single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(_col(c)), r"[^\p{L}\p{N}_\s]", " "), r"(?U)\s+", " "))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use of a value that is computed once for a row: named within a lambda, an expression would be computed again for each element."""
    return F.transform(F.array(value), use)[0]


def tokens(c: Column | str) -> Column:
    """Search tokens (X03); null gives none."""
    return F.coalesce(F.regexp_extract_all(F.lower(_col(c)), F.lit(f"{WORD}+"), F.lit(0)), F.array().cast("array<string>"))


def eval_tokens(c: Column | str) -> Column:
    """Evaluation tokens (X04); empty texts give none."""
    return F.filter(F.split(F.coalesce(eval_normalize(c), F.lit("")), " "), lambda t: t != "")


def roman_to_int(c: Column | str) -> Column:
    """Subtractive scan from the right (X08); nothing readable gives null."""
    values = F.create_map(*[F.lit(x) for kv in ROMAN.items() for x in kv])
    digits = F.reverse(F.split(F.lower(_col(c)), ""))
    steps = F.transform(F.filter(digits, lambda d: d != ""), lambda d: F.coalesce(F.try_element_at(values, d), F.lit(0)))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("last"))
    add = lambda acc, v: F.struct(F.when(v < acc["last"], acc["total"] - v).otherwise(acc["total"] + v).alias("total"), F.greatest(v, acc["last"]).alias("last"))
    total = F.aggregate(steps, start, add, lambda acc: acc["total"])
    return F.when(total > 0, total)


def legal_number(c: Column | str) -> Column:
    """Leading digits, else a Roman number, else null."""
    return F.coalesce(F.regexp_extract(_col(c), r"^([0-9]+)", 1).try_cast("int"), roman_to_int(c))


def _numbers(c: Column | str, keyword: str, value: str) -> Column:
    found = F.regexp_extract_all(F.lower(_col(c)), F.lit(rf"{EDGE}{keyword}\s*\.?\s*({value})"), F.lit(1))
    return F.filter(F.transform(F.coalesce(found, F.array().cast("array<string>")), legal_number), lambda n: n.isNotNull())


def article_numbers(c: Column | str) -> Column:
    return _numbers(c, ARTICLE, "[0-9]+[a-z]?")


def clause_numbers(c: Column | str) -> Column:
    return _numbers(c, CLAUSE, "[0-9]+[a-z]?")


def chapter_numbers(c: Column | str) -> Column:
    return _numbers(c, CHAPTER, rf"(?:[0-9]+|[ivxlcdm]+)(?:$|[^\p{{L}}\p{{N}}_])")


def section_numbers(c: Column | str) -> Column:
    return _numbers(c, SECTION, rf"(?:[0-9]+|[ivxlcdm]+)(?:$|[^\p{{L}}\p{{N}}_])")


def clause_markers(c: Column | str) -> Column:
    """Numbers of lines that start with "N. " (X06)."""
    found = F.regexp_extract_all(_col(c), F.lit(r"(?:^|[\n\r])\s*([0-9]+)\.\s+"), F.lit(1))
    return F.array_distinct(F.filter(F.transform(found, lambda n: n.try_cast("int")), lambda n: n.isNotNull()))


def references(c: Column | str, current: Column | None = None) -> Column:
    """Struct of primary article and referenced articles (X09): all but the current one, or all after the first."""
    found = article_numbers(c)
    refs = F.filter(found, lambda n: n != current) if current is not None else F.slice(found, F.lit(2), F.greatest(F.size(found), F.lit(1)))
    return F.struct(F.try_element_at(found, F.lit(1)).alias("primary"), F.array_distinct(refs).alias("refs"))


def chunk_id(article: Column | str, content: Column | str) -> Column:
    """MD5 of article and content in the shape of a UUID."""
    digest = F.md5(F.concat_ws("::", F.coalesce(_col(article), F.lit("no_article")), _col(content)))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def clause_tags(c: Column | str) -> Column:
    """Numbers behind [clause] tags."""
    return F.transform(F.regexp_extract_all(_col(c), F.lit(r"\[clause\]\s*([0-9]+)"), F.lit(1)), lambda n: n.cast("int"))


def strip_clause_tags(c: Column | str) -> Column:
    return F.regexp_replace(_col(c), r"\[clause\]\s*([0-9]+)", "$1")


def strips(c: Column | str, least: int = 20) -> Column:
    """Sentences of at least ``least`` characters, else the whole text."""
    parts = F.filter(F.transform(F.split(_col(c), r"(?<=[.!?;\n])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.when(F.size(parts) > 0, parts).otherwise(F.array(_col(c)))


def word_windows(c: Column | str, size: int = 50, least: int = 10) -> Column:
    """Runs of ``size`` words; a last run under ``least`` words joins the one before."""

    def cut(words: Column) -> Column:
        n = F.size(words)
        full = F.greatest(F.lit(1), F.floor(n / size) + F.when(n % size >= least, 1).otherwise(0))
        runs = F.transform(F.sequence(F.lit(0), full - 1), lambda i: F.array_join(F.slice(words, (i * size + 1).cast("int"), F.when(i == full - 1, n).otherwise(F.lit(size)).cast("int")), " "))
        return F.when(n > 0, runs).otherwise(F.array().cast("array<string>"))

    return bound(F.filter(F.split(_col(c), r"\s+"), lambda w: w != ""), cut)


def list_items(c: Column | str, most: int = 4) -> Column:
    """Items of a model's list answer: bullets and quotes stripped, blanks dropped, unique, capped."""
    lines = F.transform(F.split(_col(c), "\n"), lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(s), r"^[0-9.\-*)\s]+", ""), "^[\"']+|[\"']+$", "")))
    return F.slice(F.array_distinct(F.filter(lines, lambda s: s != "")), 1, most)


def chosen_letters(c: Column | str, n: int) -> Column:
    """0-based choices behind "Correct Answer:" in order, unique and in range; the letter after the last choice means
    none and ends the list (X18)."""
    tail = F.regexp_extract(_col(c), r"(?is)correct answer:(.*)$", 1)
    text = F.when(tail != "", tail).otherwise(_col(c))
    inside = F.regexp_extract_all(text, F.lit(r"\(([A-Z])\)"), F.lit(1))
    bare = F.regexp_extract_all(text, F.lit(r"(?:^|[^A-Za-z])([A-Z])(?![A-Za-z])"), F.lit(1))
    letters = F.transform(F.when(F.size(inside) > 0, inside).otherwise(bare), lambda x: F.ascii(x) - 65)
    start = F.struct(F.array().cast("array<int>").alias("got"), F.lit(False).alias("over"))
    step = lambda acc, x: F.struct(F.when(acc["over"] | (x >= n) | F.array_contains(acc["got"], x), acc["got"]).otherwise(F.array_append(acc["got"], x)).alias("got"), (acc["over"] | (x == n)).alias("over"))
    return F.aggregate(letters, start, step, lambda acc: acc["got"])


def rewritten(answer: Column | str, original: Column | str) -> Column:
    """First line of a rewriter's answer that is no fence, without quotes; the original query if nothing is left."""
    lines = F.filter(F.transform(F.split(F.coalesce(_col(answer), F.lit("")), "\n"), lambda s: F.trim(F.regexp_replace(F.trim(s), "^[\"'`]+|[\"'`]+$", ""))), lambda s: (s != "") & ~s.startswith("```"))
    return F.coalesce(F.try_element_at(lines, F.lit(1)), _col(original))


def as_ints(c: Column | str) -> Column:
    """Strings that are whole numbers, unique, in first order."""
    return F.array_distinct(F.filter(F.transform(_col(c), lambda x: x.try_cast("int")), lambda x: x.isNotNull()))


def usable_k(max_chunks: int, ks: tuple[int, ...] = (1, 3, 5, 10, 20)) -> list[int]:
    """Cut-offs for retrieval metrics (X28): the usual ones, then powers of ten below 100 * max_chunks."""
    out, n = list(ks), 2
    while 10**n < 100 * max_chunks:
        out.append(10**n)
        n += 1
    return out
