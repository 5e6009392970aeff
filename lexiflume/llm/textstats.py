"""Statistics of whole texts, and the bounded sample of labelled rows from which models learn."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.words import WordHash, mix

#: Labelled rows from which a model learns, about; the rest of the labels is not read beyond their ids.
LABELLED_SAMPLE = 12_000

SYMBOLS = "#*$%&|<>"
_P = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: Statistics that models see; names match the columns of stats().
RATIOS = ("log_words", "log_chars", "word_length", "symbol_share", "dup_line_share", "repeat_share", "upper_share", "digit_share", "mark_share", "distinct_share", "line_words", "bang_share", "long_word_share")


def repeated_words(hashes: np.ndarray) -> int:
    """Words in windows of three words that occur at least twice."""
    n = len(hashes)
    if n < 4:
        return 0
    windows = mix(hashes[:-2] * _P[0] + hashes[1:-1] * _P[1] + hashes[2:] * _P[2])
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    inside = np.zeros(n - 2, bool)
    inside[order[1:][same]] = inside[order[:-1][same]] = True
    covered = np.zeros(n, bool)
    for i in range(3):
        covered[i : n - 2 + i] |= inside
    return int(covered.sum())


def stats(text: str | None, memo: WordHash) -> tuple[tuple[int, ...], tuple[float, ...], np.ndarray]:
    """COUNTS, RATIOS and the word hashes of a text; null is as empty."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, word_bytes = len(words), sum(map(len, words))
    hashes = memo.array(words)
    chars = len(text) - (len(raw) - word_bytes)
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()] if n else []
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(hashes)
    upper, digits = len(raw) - len(raw.translate(None, b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")), len(raw) - len(raw.translate(None, b"0123456789"))
    marks = len(raw) - len(raw.translate(None, b".,;:!?\"'()-"))
    c, w = max(chars, 1), max(n, 1)
    ratios = (
        np.log1p(n), np.log1p(chars), chars / w, symbols / c, dup / max(len(lines), 1), repeat / w, upper / c, digits / c, marks / c,
        len(set(words)) / w, n / max(len(lines), 1), text.count("!") / c, sum(len(x) > 20 for x in words) / w,
    )
    return (n, chars, symbols, dup, repeat), ratios, hashes


def labelled(documents: DataFrame, labels: DataFrame, column: str, folds: int, bound: int = LABELLED_SAMPLE) -> DataFrame:
    """Columns text and y of about ``bound`` labelled rows at most, by the hash of doc_id; rows whose crc32 of the
    doc_id as text divides by ``folds`` never come. Null labels and ids are left out; several labels of an id are averaged,
    of several texts of an id the least is taken."""
    known = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).where(F.crc32(F.col("doc_id").cast("string")) % folds != 0)
    rate = min(1.0, bound / max(1, known.count()))
    picked = known.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 2) < F.lit(int(rate * (1 << 62)))).groupBy("doc_id").agg((F.avg(column) >= 0.5).cast("int").alias("y")).limit(2 * bound)
    rows = documents.select("doc_id", "text").join(F.broadcast(picked), "doc_id")
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y")
