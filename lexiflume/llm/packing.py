"""Best-fit packing of tokenised documents into sequences of bounded length.

Each document is tokenised whole (a vocabulary file of the tokenizers library) and ends with one closing id. Only
longer documents are cut, into full pieces and a last shorter one. Longest first, a piece goes to the fullest open sequence
that still holds it (best-fit decreasing), found through a segment tree over remaining capacities in logarithmic time.

Pieces of one length are alike, and so are sequences with one remaining capacity. So the driver packs the table of lengths and
their numbers, of as many rows as a sequence has tokens at most, with runs of alike sequences as the tree's leaves:
the whole corpus is packed at once, as by best-fit decreasing piece by piece. Spark then numbers the pieces of each length, and a
number gives the place.

Null and empty texts give the closing id alone. Repeated rows are packed as often as they occur; an empty table gives no rows; pieces of
equal length go by doc_id, piece and ids within runs of rows; columns other than id and text are ignored, whatever their names.
"""

from __future__ import annotations

import os
import re
import zlib

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.numbering import numbered, run_of, spread
from lexiflume.llm.scratch import Scratch

#: Words that one Python worker remembers at most.
MEMO = 700_000
#: Words encoded by one call, with a mark between them.
AT_ONCE, MARK = 2000, "~"
#: Between a letter or digit (ASCII, or a Latin-1 letter) and an ASCII mark other than the apostrophe no rule of the vocabulary
#: looks across: its pattern keeps letters and marks apart (but for 's and the like), and no mark there takes part in NFC.
_MARKS = rb"[!-&(-/:-@\[-`{-~]"
_LATIN = rb"\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]"
_AFTER = re.compile(_MARKS + rb"(?:(?<=[a-z0-9]" + _MARKS + rb")|(?<=" + _LATIN + _MARKS + rb"))")
_BEFORE = re.compile(_MARKS + rb"(?=[a-z0-9]|" + _LATIN + rb")")

_loaded: dict[str, Encoder] = {}


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers, the same as the tokenizer gives.

    The vocabulary lower-cases, drops white space and merges within words only, so texts are cut at ASCII white space,
    and where a letter meets a mark, and each distinct part is encoded once. Texts that may hold a special token (they
    start with "<|") go to the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.words = Tokenizer.from_file(path), {}
        self.mark = self._ids([MARK])[0]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, words: list[bytes]) -> None:
        sign = MARK.encode()
        alone = [w for w in words if sign in w]
        words = [w for w in words if sign not in w]
        mark = int.from_bytes(self.mark, "little")
        for i in range(0, len(words), AT_ONCE):
            some = words[i : i + AT_ONCE]
            ids = np.frombuffer(self._ids([(b" " + sign + b" ").join(some).decode("utf-8")])[0], "<u4")
            cuts = np.flatnonzero(ids == mark)
            if len(self.mark) != 4 or len(cuts) != len(some) - 1:
                alone += some
                continue
            raw, starts, ends = ids.tobytes(), [0, *(4 * cuts + 4).tolist()], [*(4 * cuts).tolist(), 4 * len(ids)]
            self.words.update((w, raw[a:b]) for w, a, b in zip(some, starts, ends, strict=True))
        if alone:
            self.words.update(zip(alone, self._ids([w.decode("utf-8") for w in alone]), strict=True))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        raw = [t.encode("utf-8") if t else b"" for t in texts]
        cut = [None if b"<|" in r else _BEFORE.sub(rb"\g<0> ", _AFTER.sub(rb" \g<0>", r.lower())).split() for r in raw]
        words = set().union(*(c for c in cut if c))
        new = words.difference(self.words)
        if len(self.words) + len(new) > MEMO:
            self.words.clear()
            new = words
        self._learn(list(new))
        get = self.words.__getitem__
        return [self._ids([t])[0] if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


class Capacities:
    """Segment tree over remaining capacities 0..size; a leaf holds the runs of open sequences (first, number) that have it."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = bytearray(2 * self.leaves)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(size + 1)]

    def put(self, capacity: int, first: int, n: int) -> None:
        self.runs[capacity].append((first, n))
        at = capacity + self.leaves
        while at and not self.any[at]:
            self.any[at] = 1
            at >>= 1

    def take(self, need: int) -> tuple[int, int, int] | None:
        """A run of the open sequences with the least capacity of at least ``need``, removed: capacity, first, number."""
        at = need + self.leaves
        if not self.any[at]:
            while at > 1 and (at & 1 or not self.any[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.any[2 * at] else 2 * at + 1
        capacity = at - self.leaves
        run = self.runs[capacity].pop()
        if not self.runs[capacity]:
            while at and not (at < self.leaves and (self.any[2 * at] or self.any[2 * at + 1])):
                self.any[at] = 0
                at >>= 1
        return capacity, *run


@dataclass
class Places:
    """Where the pieces of one length go: those from number ``start[i]`` on lie ``per[i]`` to a sequence, from sequence ``first[i]``
    and offset ``offset[i]`` on."""

    length: int
    start: np.ndarray
    per: np.ndarray
    first: np.ndarray
    offset: np.ndarray

    def __call__(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.start, numbers, "right") - 1
        past = numbers - self.start[at]
        return self.first[at] + past // self.per[at], self.offset[at] + past % self.per[at] * self.length


def best_fit_decreasing(counts: dict[int, int], size: int) -> dict[int, Places]:
    """counts: how many pieces have each length from 1 to size. The places of each length's pieces."""
    tree, made, out = Capacities(size), 0, {}
    for length in sorted(counts, reverse=True):
        left, rows = counts[length], []
        while left:
            found = tree.take(length)
            if found is None:
                found = size, made, -(-left // (size // length))
                made += found[2]
            capacity, first, n = found
            # A sequence that still holds the length stays the tightest one, so it is filled up before the next.
            per = capacity // length
            full, rest = (n, 0) if left >= n * per else divmod(left, per)
            if full:
                rows.append((counts[length] - left, per, first, size - capacity))
                left -= full * per
                if capacity > per * length:
                    tree.put(capacity - per * length, first, full)
            if rest:
                rows.append((counts[length] - left, per, first + full, size - capacity))
                left -= rest
                tree.put(capacity - rest * length, first + full, 1)
            if full + (rest > 0) < n:
                tree.put(capacity, first + full + (rest > 0), n - full - (rest > 0))
        if rows:
            out[length] = Places(length, *(np.array(c, np.int64) for c in zip(*rows, strict=True)))
    return out


def pack(documents: DataFrame, tokenizer_path: str, size: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset for each piece."""
    scratch = scratch or Scratch(documents.sparkSession)

    def pieces(batches):
        end, encode = end_id.to_bytes(4, "little"), encoder(tokenizer_path).encode
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                out = {"doc_id": [], "piece": [], "start": [], "length": [], "ids_crc32": []}
                for doc, ids in zip(batch.column("doc_id").to_pylist(), encode(batch.column("text").to_pylist()), strict=True):
                    ids += end
                    for i, start in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[start : start + 4 * size]
                        for k, v in zip(out, (doc, i, start // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[k].append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["piece"], pa.int32()), *(pa.array(out[k], pa.int64()) for k in ("start", "length", "ids_crc32"))], list(out))

    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    made = scratch.keep("pieces", docs.mapInArrow(pieces, columns).withColumn("spread", spread()))
    counts = {x.length: x.n for x in made.groupBy("length").agg(F.count("*").alias("n")).collect()}  # size rows at most
    places = documents.sparkSession.sparkContext.broadcast(best_fit_decreasing(counts, size))
    dealt = scratch.keep("dealt", made.withColumn("run", run_of(sum(counts.values()), "doc_id", "piece", "ids_crc32", "spread")).drop("spread"))
    scratch.drop("pieces")

    def place(batches):
        for b in batches:
            length, number = b.column("length").to_numpy(), b.column("number").to_numpy()
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for n in np.unique(length).tolist():
                here = length == n
                sequence[here], offset[here] = places.value[n](number[here])
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], [*b.schema.names[:5], "sequence_id", "offset"])

    ranked = numbered(dealt, "length", ["doc_id", "piece", "ids_crc32"])
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "number").mapInArrow(place, columns + ", sequence_id long, offset long")
