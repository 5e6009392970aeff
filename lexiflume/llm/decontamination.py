"""Benchmark decontamination: SimHash over windows as long as each item, searched through a multi-index, then verified.

Items and windows are bags of five-word shingles (an item with fewer words is one shingle as a whole). A window's
64-bit fingerprint is looked up in four tables, one for each block of 16 bits, which hold every value within RADIUS // 4 bits of an
item's block: two fingerprints within RADIUS bits agree within RADIUS // 4 in some block, so none is missed. Candidates
are verified by weighted similarity: sum of w * min(counts) over sum of w * max(counts), where an item's shingle weighs
1 / (different items that hold it), any other 1: repeats of an item change nothing. Where the same sums with all weights 1 give more, that counts, so
a template that many items share hides no near copy of one of them. A document shorter than an item is one window as a whole. Windows without any shingle of an item have similarity 0 with it and are
not fingerprinted, which loses nothing.

Benchmarks are broadcast in blocks of ITEM_WORDS words, one pass over the documents for each block, so any size of
benchmark works. Null and empty texts are clean; items without words match nothing; repeated rows give repeated rows;
documents and items may have a null id; an empty table gives no finds; other columns are kept or ignored, whatever their names.
Of windows equally similar to an item the first stands. Texts are fingerprinted STRETCH words at a time, so memory does not grow with their length.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.scratch import Scratch
from lexiflume.llm.words import hashed_words, shingles

K, RADIUS, THRESHOLD = 5, 15, 0.8
#: Words of benchmark items that are broadcast at once.
ITEM_WORDS = 1_000_000
#: Items of a block up to which the index holds each value near an item's (17 kB an item); beyond, the near values of a window's are
#: looked up among the items' own (24 bytes an item). Both find the same.
FLIPPED = 4096
#: Windows that are fingerprinted at once.
STRETCH = 4096

_SHIFTS = np.arange(64, dtype=np.uint64)


def signs(hashes: np.ndarray) -> np.ndarray:
    """A row of +1 and -1 for each shingle."""
    return (((hashes[:, None] >> _SHIFTS) & np.uint64(1)).astype(np.int8) * 2 - 1).astype(np.int32)


def _packed(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8")[:, 0]


def simhash(hashes: np.ndarray) -> int:
    return int(_packed(signs(hashes).sum(0, keepdims=True))[0])


_FLIPS = np.array([m for r in range(RADIUS // 4 + 1) for m in (sum(1 << b for b in c) for c in combinations(range(16), r))], np.uint16)


class Index:
    """The fingerprints of the items of one block with the same shingle size k and the same number of words."""

    def __init__(self, items: list[dict], flipped: bool = True):
        self.prints, self.flipped, self.tables = np.array([i["print"] for i in items], np.uint64), flipped, []
        for b in range(4):
            values, owners = self._part(self.prints, b), np.arange(len(items), dtype=np.int32)
            if flipped:
                values, owners = (values[:, None] ^ _FLIPS).ravel(), np.repeat(owners, len(_FLIPS))
            order = np.argsort(values, kind="stable")
            self.tables.append((values[order], owners[order]))

    @staticmethod
    def _part(prints: np.ndarray, b: int) -> np.ndarray:
        return ((prints >> np.uint64(16 * b)) & np.uint64(0xFFFF)).astype(np.uint16)

    def within(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (window number, item number) whose fingerprints differ in at most RADIUS bits."""
        found, step, items = [np.zeros(0, np.int64)], len(windows) if self.flipped else 256, len(self.prints)
        for first in range(0, len(windows), max(step, 1)):
            some = windows[first : first + step]
            for b, (values, owners) in enumerate(self.tables):
                part, number = self._part(some, b), np.arange(first, first + len(some))
                if not self.flipped:
                    part, number = (part[:, None] ^ _FLIPS).ravel(), np.repeat(number, len(_FLIPS))
                a, z = np.searchsorted(values, part, "left"), np.searchsorted(values, part, "right")
                n = z - a
                w = np.repeat(number, n)
                o = owners[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())]
                near = np.bitwise_count(windows[w] ^ self.prints[o]) <= RADIUS
                found.append(w[near] * items + o[near])
        both = np.unique(np.concatenate(found))
        return both // items, both % items


def similarity(window: np.ndarray, item: dict) -> float:
    """The greater of the weighted and the plain one: window is its shingles, item has sorted distinct shingles, counts and weights."""
    got, counts = np.unique(window, return_counts=True)
    at = np.minimum(np.searchsorted(got, item["keys"]), len(got) - 1)
    mine = np.where(got[at] == item["keys"], counts[at], 0)
    shared = mine.sum()
    low, high, other = np.minimum(mine, item["counts"]), np.maximum(mine, item["counts"]), len(window) - shared
    return max(float((item["weights"] * low).sum() / ((item["weights"] * high).sum() + other)), float(low.sum() / (high.sum() + other)))


class Flat:
    """Items of one shingle size and length in a few arrays."""

    def __init__(self, items: list[dict], flipped: bool):
        self.index = Index(items, flipped)
        self.row, self.item_id = np.array([i["row"] for i in items], np.int64), [i["item_id"] for i in items]
        self.ends = np.cumsum([len(i["keys"]) for i in items])
        self.keys, self.weights = (np.concatenate([i[c] for i in items]) for c in ("keys", "weights"))
        self.counts = np.concatenate([i["counts"] for i in items]).astype(np.int32)

    def __getitem__(self, i: int) -> dict:
        cut = slice(int(self.ends[i - 1]) if i else 0, int(self.ends[i]))
        return {"row": int(self.row[i]), "item_id": self.item_id[i], "keys": self.keys[cut], "counts": self.counts[cut], "weights": self.weights[cut]}


class Block:
    """Items in reach of one pass, by shingle size."""

    def __init__(self, rows: list[dict]):
        self.by_size: dict[int, dict] = {}
        for k in sorted({r["k"] for r in rows}):
            by_length: dict[int, list[dict]] = {}
            for r in rows:
                if r["k"] == k:
                    by_length.setdefault(r["n_shingles"], []).append(r)
            lengths = sorted(by_length)
            keys = np.concatenate([r["keys"] for n in lengths for r in by_length[n]])
            of = np.repeat(np.arange(len(lengths)), [sum(len(r["keys"]) for r in by_length[n]) for n in lengths])
            pairs = np.unique(np.stack([keys, of.astype(np.uint64)]), axis=1)  # which lengths a shingle leads to
            self.by_size[k] = {"lengths": lengths, "pairs": (pairs[0], pairs[1].astype(np.int32)), "items": [Flat(by_length[n], len(rows) <= FLIPPED) for n in lengths]}

    def search(self, k: int, grams: np.ndarray, threshold: float) -> list[tuple]:
        """(item id, similarity, start, words) for one document: the best window of each item that reaches the threshold."""
        part = self.by_size[k]
        keys, of = part["pairs"]
        at = np.minimum(np.searchsorted(keys, grams), len(keys) - 1)
        anchors = np.flatnonzero(keys[at] == grams)
        best: dict[int, tuple] = {}
        if not len(anchors):
            return []
        reach = part["lengths"][-1]
        for region in np.split(anchors, np.flatnonzero(np.diff(anchors) >= 2 * reach) + 1):
            lo, hi = max(0, int(region[0]) - reach + 1), min(len(grams), int(region[-1]) + reach)
            for first in range(lo, hi, STRETCH):
                here = grams[first : min(hi, first + STRETCH + reach - 1)]
                hits = region[slice(*np.searchsorted(region, [first, first + len(here)]))] - first
                if not len(hits):
                    continue
                sums = np.concatenate([np.zeros((1, 64), np.int32), np.cumsum(signs(here), 0)])
                spans = np.unique(here[hits])
                a, z = np.searchsorted(keys, spans, "left"), np.searchsorted(keys, spans, "right")
                hit = np.zeros(len(here) + 1, np.int64)
                hit[1:][hits] = 1
                hit = np.cumsum(hit)
                for which in sorted({int(x) for i, j in zip(a, z, strict=True) for x in of[i:j]}):
                    n = min(part["lengths"][which], len(grams))  # less than the item's only if the whole document is shorter
                    if n > len(here):
                        continue
                    items = part["items"][which]
                    starts = np.flatnonzero(hit[n:] > hit[:-n])
                    starts = starts[starts < STRETCH]
                    prints = _packed(sums[starts + n] - sums[starts])
                    for w, i in zip(*items.index.within(prints), strict=True):
                        item, start = items[int(i)], int(starts[w])
                        s = similarity(here[start : start + n], item)
                        key = (-s, first + start)
                        if s >= threshold and (item["row"] not in best or key < best[item["row"]][0]):
                            best[item["row"]] = (key, (item["item_id"], s, first + start, n + k - 1))
        return [v for _, v in best.values()]


def prepared(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """One row per item with words: item_id, row, n_words, k, keys (sorted shingles), counts, weights, print."""

    def cut(batches):
        for batch in batches:
            out = {"n_words": [], "k": [], "n_shingles": [], "keys": [], "counts": [], "print": []}
            for _, hashes, counts in hashed_words(batch.column("text")):
                ends = np.cumsum(counts)
                for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
                    grams = shingles(hashes[end - n : end], K)
                    keys, times = np.unique(grams, return_counts=True)
                    for name, value in zip(out, (n, min(n, K), len(grams), keys.view(np.int64), times, simhash(grams) - 2**63 if n else 0), strict=True):
                        out[name].append(value)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64()]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), *(pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True))], ["item_id", *out])

    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.col(text_col).alias("text"))
    return items.mapInArrow(cut, "item_id long, n_words long, k long, n_shingles long, keys array<long>, counts array<long>, print long").where("n_words > 0")


def _blocks(benchmark: DataFrame, scratch: Scratch, id_col: str = "item_id", text_col: str = "text"):
    """Broadcast blocks of items, made one after another."""
    spark = benchmark.sparkSession
    items = scratch.keep("items", prepared(benchmark, id_col, text_col).withColumn("row", F.monotonically_increasing_id()))
    held = scratch.keep("held", items.dropDuplicates(["keys", "counts"]).select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("df")))
    weighted = items.select("row", F.posexplode("keys").alias("pos", "key")).join(held, "key").groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "df"))), lambda x: 1.0 / x["df"]).alias("weights"))
    items = scratch.keep("weighted", items.join(weighted, "row"))
    n_blocks = max(1, -(-(items.agg(F.sum("n_words")).first()[0] or 0) // ITEM_WORDS))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n_blocks)))
    for b in range(n_blocks):
        rows = []
        for r in dealt.where(F.col("block") == b).orderBy("row").toLocalIterator():
            rows.append({"item_id": r["item_id"], "row": r["row"], "k": r["k"], "n_shingles": r["n_shingles"], "keys": np.array(r["keys"], np.int64).view(np.uint64), "counts": np.array(r["counts"], np.int64), "weights": np.array(r["weights"]), "print": np.uint64(r["print"] + 2**63)})
        yield spark.sparkContext.broadcast(Block(rows))


def _found(batch, block: Block, column: int, threshold: float):
    """The finds of each text of a batch."""
    for _, hashes, counts in hashed_words(batch.column(column)):
        ends = np.cumsum(counts).tolist()
        whole = {k: shingles(hashes, k) if len(hashes) >= k else hashes[:0] for k in block.by_size}
        for n, end in zip(counts.tolist(), ends, strict=True):
            yield [x for k in block.by_size if n >= k for x in block.search(k, whole[k][end - n : end - k + 1], threshold)]


def contaminations(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """doc_id, item_id, similarity, start_word, n_words: for each document and item that it contains, the best window."""
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for block in _blocks(benchmark, scratch or Scratch(documents.sparkSession)):

        def find(batches, block=block):
            for batch in batches:
                rows = [(d, *x) for d, found in zip(batch.column("doc_id").to_pylist(), _found(batch, block.value, 1, threshold), strict=True) for x in found]
                cols = zip(*rows, strict=True) if rows else [[]] * 5
                kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "similarity", "start_word", "n_words"])

        parts.append(docs.mapInArrow(find, "doc_id long, item_id long, similarity double, start_word long, n_words long"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The documents, with all their columns, in which no item is found."""
    at = documents.columns.index(text_col)
    for block in _blocks(benchmark, scratch or Scratch(documents.sparkSession)):

        def clean(batches, block=block):
            for batch in batches:
                yield batch.filter(pa.array([not f for f in _found(batch, block.value, at, threshold)], pa.bool_()))

        documents = documents.mapInArrow(clean, documents.schema)
    return documents
