"""Word and shingle hashing shared by the operators; runs inside Arrow batches on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Words remembered by one Python worker before its memo starts afresh: a bound on memory, not on the input.
MEMO = 100_000
_ODD = tuple(np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


class WordHash(dict):
    """Memo of word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= MEMO:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def array(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def split_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space (bytes.lower and bytes.split know no other); null gives none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of each run of k words, in order. Fewer words: the whole sequence as one. None: empty."""
    n = len(hashes)
    if not n:
        return hashes
    size = min(k, n)
    out = np.full(n - size + 1, np.uint64(size))
    for i in range(size):
        out = out * _ODD[i % 5] + mix(hashes[i : n - size + 1 + i] + np.uint64(i)) if k > 5 else out + hashes[i : n - size + 1 + i] * _ODD[i]
    return mix(out)


#: Bytes of text that are hashed at once.
SLICE = 1 << 17
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: A random value for each byte, A-Z as a-z; words are polynomials over these modulo 2^64.
_VALUE = np.random.default_rng(20).integers(1, 2**63, 256, np.uint64)[_LOWER]
_BASE = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            steps = np.full(max(n, SLICE), np.uint64(base))
            steps[0] = 1
            _powers[i] = np.cumprod(steps)
    return _powers


def _hashed(data: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the words of texts data[edges[i]:edges[i + 1]], how many each text has, and the words' last three bytes."""
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(edges) - 1, np.int64), np.zeros(0, np.int64)
    word = ~_BLANK[data]
    begins, ends = word.copy(), word.copy()
    begins[1:] &= ~word[:-1]
    ends[:-1] &= ~word[1:]
    inner = edges[(edges > 0) & (edges < len(data))]
    begins[inner] = word[inner]
    ends[inner - 1] = word[inner - 1]
    a, b = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    up, down = _power(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_VALUE[data] * up[: len(data)], out=sums[1:])
    tails = sum(np.where(b - a > i, _LOWER[data[b - 1 - i]], 0) << (8 * i) for i in range(3))
    return mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64)), np.diff(np.searchsorted(a, edges)), tails


def tailed_words(column: pa.Array, size: int = SLICE) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """The words of each text of a string column, hashed in slices of whole texts: (first row, hashes, words per row, last
    three bytes of each word, the last one lowest). A slice has ``size`` bytes, or one text.

    Words are as split_words cuts them, A-Z lower-cased; null counts as empty."""
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        hashes, counts, tails = _hashed(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        yield at, hashes, counts, tails
        at = end


def hashed_words(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """As tailed_words, without the last bytes."""
    for at, hashes, counts, _ in tailed_words(column):
        yield at, hashes, counts


def row_shingles(column: pa.Array, k: int) -> Iterator[np.ndarray]:
    """The set of k-word shingles of each text, as sorted hashes."""
    for _, hashes, counts in hashed_words(column):
        ends = np.cumsum(counts)
        whole = shingles(hashes, k) if len(hashes) >= k else hashes[:0]
        for n, end in zip(counts.tolist(), ends.tolist(), strict=True):
            s = np.sort(whole[end - n : end - k + 1]) if n >= k else shingles(hashes[end - n : end], k)
            yield s[np.concatenate([[True], s[1:] != s[:-1]])] if len(s) > 1 else s
