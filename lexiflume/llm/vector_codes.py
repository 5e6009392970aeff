"""Vector codes: each vector is cut into parts, each part is stored as the index of its nearest entry in a small codebook.

Codebooks are fitted to all vectors: a round sends the codebooks (of a fixed size) to the tasks, a task assigns the parts of its vectors and
adds them up for each entry, Spark adds up the tasks' sums, and the driver divides them. Vectors are never shuffled.

Nearest entries are found by segment-mean lower bounds, coarse to fine. For a block of s components with sum S and residual norm r
(the length of what is left when the mean is taken off), (Sx - Sc)^2 / s + (rx - rc)^2 is at most the squared distance within the block.
With the whole part as one block, then halves, then quarters, entries whose bound is greater than the exact distance to the most promising one go;
those left get exact integer distances. Bounds have a margin above their rounding errors, so no nearest entry is lost, ties included.

Rows whose vector is null or holds a null, NaN or infinity are left out. Components become floor(scale * x); those beyond
`limit` (8192 for vectors of 64 at the default scale) count as the limit, so that sums of squares fit a long. Vectors that are shorter than the longest one, or than a
multiple of the parts, go on with zeros; empty ones are all zeros. Codebooks start with the least vec_ids, each once
(of rows with one vec_id the least vector; null ids last); with fewer vec_ids than entries the codebooks are smaller. Repeated rows are coded and counted
each. label_error is null if its sum doesn't fit a long. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.lookup import lookup
from lexiflume.llm.scratch import Scratch


def limit(dims: int) -> int:
    """Greatest size of a component: sixteen times the squared distance of two vectors fits a long."""
    return 1 << ((58 - max(1, dims - 1).bit_length()) // 2 - 1)


def _block_sizes(d: int) -> list[int]:
    """d and its halves, as long as these are whole and greater than 1."""
    sizes = [d]
    while sizes[-1] % 2 == 0 and sizes[-1] > 2:
        sizes.append(sizes[-1] // 2)
    return sizes


def _summary(v: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum and residual norm of each block of s components."""
    blocks = v.reshape(len(v), -1, s)
    sums = blocks.sum(2)
    return sums.astype(float), np.sqrt((s * (blocks * blocks).sum(2) - sums * sums) / s)


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Index of each row's nearest entry (of equal ones the first), its squared distance, and how many pairs of row and entry each level and the
    exact distances looked at. x and book hold int64."""
    n, (k, d) = len(x), book.shape
    if not n or not d:
        return np.zeros(n, np.int64), np.zeros(n, np.int64), [n * k]
    # Far above the rounding errors of the bounds, which are about 1e-15 of the squared lengths.
    margin = 1e-9 * ((x * x).sum(1)[:, None] + (book * book).sum(1)) + 1e-6
    looked, pairs, worst = [], None, None
    for s in _block_sizes(d):
        (xs, xr), (bs, br) = _summary(x, s), _summary(book, s)
        if pairs is None:
            bound = ((xs[:, None, :] - bs) ** 2 / s + (xr[:, None, :] - br) ** 2).sum(2)
            looked.append(bound.size)
            best = bound.argmin(1)
            worst = ((x - book[best]) ** 2).sum(1)
            pairs = np.nonzero(bound <= worst[:, None] + margin)
        else:
            i, j = pairs
            looked.append(len(i))
            bound = ((xs[i] - bs[j]) ** 2 / s + (xr[i] - br[j]) ** 2).sum(1)
            left = bound <= worst[i] + margin[i, j]
            pairs = i[left], j[left]
    i, j = pairs
    looked.append(len(i))
    distance = ((x[i] - book[j]) ** 2).sum(1)
    first = np.flatnonzero(np.append(True, i[1:] != i[:-1]))  # every row has the entry that gave its worst
    least = np.minimum.reduceat(distance, first)
    at = np.flatnonzero(distance == np.repeat(least, np.diff(np.append(first, len(i)))))
    return j[at[np.unique(i[at], return_index=True)[1]]], least, looked


def _whole_vectors(scale: int):
    """(vec_id, label, v) to the same with whole numbers; rows that hold what is no number go."""

    def work(batches):
        for b in batches:
            column = b.column("v")
            lengths = pc.fill_null(pc.list_value_length(column), 0).to_numpy().astype(np.int64)
            values = column.flatten().to_numpy(zero_copy_only=False).astype(float)
            odd = np.append(0, np.cumsum(~np.isfinite(values)))
            ends = np.cumsum(lengths)
            good = (odd[ends] == odd[ends - lengths]) & column.is_valid().to_numpy(zero_copy_only=False)
            with np.errstate(invalid="ignore", over="ignore"):
                whole = np.clip(np.floor(np.nan_to_num(values) * scale), -(2.0**30), 2.0**30).astype(np.int32)
            kept = pa.ListArray.from_arrays(np.append(0, np.cumsum(lengths[good])).astype(np.int32), pa.array(whole[np.repeat(good, lengths)]))
            at = pa.array(np.flatnonzero(good))
            yield pa.RecordBatch.from_arrays([b.column("vec_id").take(at), b.column("label").take(at), kept], ["vec_id", "label", "v"])

    return work


def _parts(column: pa.Array, dims: int, parts: int) -> np.ndarray:
    """Vectors as (row, part, position), cut at the limit and filled up with zeros."""
    lengths = np.diff(column.offsets.to_numpy())
    values = np.clip(column.flatten().to_numpy().astype(np.int64), -limit(dims), limit(dims))
    if (lengths != dims).any():
        out = np.zeros((len(lengths), dims), np.int64)
        out[np.arange(dims) < lengths[:, None]] = values
        values = out
    return values.reshape(len(lengths), parts, dims // parts)


def _sums(books: list[np.ndarray], dims: int):
    """Of each part and entry: sums by position, and the number of vectors that it is nearest to."""

    def work(batches):
        parts, (k, d) = len(books), books[0].shape
        sums, counts = np.zeros((parts, k, d), np.int64), np.zeros((parts, k), np.int64)
        for b in batches:
            x = _parts(b.column("v"), dims, parts)
            for p, book in enumerate(books):
                at = nearest(x[:, p], book)[0]
                counts[p] += np.bincount(at, minlength=k)
                for e in np.unique(at):
                    sums[p, e] += x[at == e, p].sum(0)
        p, e = np.nonzero(counts)
        p, e, place = np.repeat(p, d), np.repeat(e, d), np.tile(np.arange(d), len(p))
        yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(place, pa.int32()), pa.array(sums[p, e, place]), pa.array(counts[p, e])], ["part", "entry", "place", "total", "n"])

    return work


def _codes(books: list[np.ndarray], dims: int):
    def work(batches):
        for b in batches:
            x = _parts(b.column("v"), dims, len(books))
            found = [nearest(x[:, p], book)[:2] for p, book in enumerate(books)]
            codes = ["".join(f"{c:02x}" for c in row) for row in np.stack([f[0] for f in found], 1).tolist()]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("label"), pa.array(codes, pa.string()), pa.array(sum(f[1] for f in found))], ["vec_id", "label", "code", "error"])

    return work


def _first_vectors(vectors: DataFrame, entries: int) -> list[list[int]]:
    """The vectors of the least vec_ids; a task passes on as many rows as there are entries."""

    def least(batches):
        kept: list[tuple] = []
        for b in batches:
            ids = b.column("vec_id").to_pylist()
            edge = kept[-1][:2] if len(kept) == entries else None
            some = [i for i, x in enumerate(ids) if edge is None or (x is None, x or 0) <= edge]
            rows = sorted([*kept, *((ids[i] is None, ids[i] or 0, b.column("v")[i].as_py()) for i in some)])
            kept = [r for i, r in enumerate(rows) if not i or r[:2] != rows[i - 1][:2]][:entries]
        yield pa.RecordBatch.from_arrays([pa.array([None if r[0] else r[1] for r in kept], pa.int64()), pa.array([r[2] for r in kept], pa.list_(pa.int32()))], ["vec_id", "v"])

    of_tasks = vectors.select("vec_id", "v").mapInArrow(least, "vec_id long, v array<int>")
    return [x.v for x in of_tasks.groupBy("vec_id").agg(F.min("v").alias("v")).orderBy(F.col("vec_id").asc_nulls_last()).limit(entries).collect()]


def fit_codebooks(vectors: DataFrame, dims: int, parts: int, entries: int, rounds: int) -> list[np.ndarray]:
    """A codebook (entry, position) for each part of whole vectors (vec_id, v)."""
    starts = np.zeros((0, dims), np.int64)
    for v in _first_vectors(vectors, entries):
        starts = np.vstack([starts, np.pad(np.clip(np.array(v, np.int64), -limit(dims), limit(dims)), (0, dims - len(v)))])
    books = list(np.stack(np.split(starts, parts, axis=1)))
    for _ in range(rounds if len(starts) else 0):
        sums = vectors.mapInArrow(_sums(books, dims), "part int, entry int, place int, total long, n long")
        added = sums.groupBy("part", "entry", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        books = [b.copy() for b in books]
        for x in added.collect():  # a row for each component of the codebooks
            books[x.part][x.entry, x.place] = int(x.total) // x.n
    return books


def compress(embeddings: DataFrame, parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scratch: Scratch | None = None) -> DataFrame:
    """vec_id, label, code (two hex digits a part), error (squared distance to the coded vector), label_error (summed over equal labels, nulls together) and
    codebooks_sha256 of each vector that is kept."""
    if not 0 < entries <= 256:
        raise ValueError("a code has two hex digits, so there can be 1 to 256 entries")
    scratch = scratch or Scratch(embeddings.sparkSession)
    rows = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).cast("array<double>").alias("v"))
    label = rows.schema["label"].dataType.simpleString()
    vectors = scratch.keep("vectors", rows.mapInArrow(_whole_vectors(scale), f"vec_id long, label {label}, v array<int>"))
    longest = vectors.agg(F.max(F.size("v"))).first()[0] or 0
    dims = max(1, -(-longest // parts)) * parts
    books = fit_codebooks(vectors, dims, parts, entries, rounds)
    sha = hashlib.sha256(",".join(str(c) for b in books for c in b.ravel().tolist()).encode()).hexdigest()
    if not len(books[0]):
        return vectors.selectExpr("vec_id", "label", "'' as code", "0L as error", "0L as label_error", f"'{sha}' as codebooks_sha256")
    coded = scratch.keep("coded", vectors.mapInArrow(_codes(books, dims), f"vec_id long, label {label}, code string, error long"))
    sums = scratch.keep("sums", coded.groupBy("label").agg(F.try_sum("error").alias("label_error"), F.count("*").alias("n_of_label")))
    scratch.drop("vectors")
    return lookup(coded, sums, ["label"], "n_of_label", coded.count()).select("vec_id", "label", "code", "error", "label_error", F.lit(sha).alias("codebooks_sha256"))


def _sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """DuckDB: a common table expression for each assignment and each set of codebooks; vectors of one length, a multiple of the parts."""
    cut = ", ".join(f"v[{p} * len(v) // {parts} + 1 : {p + 1} * len(v) // {parts}]" for p in range(parts))
    out = f"""
with kept as materialized (select vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::double)::bigint) as v from embeddings
    where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (select vec_id, unnest([{cut}]) as x, unnest(range({parts})) as part from kept),
b0 as materialized (select part, row_number() over (partition by part order by vec_id) - 1 as entry, x as c from p where vec_id in (select vec_id from kept order by vec_id limit {entries}))"""
    for r in range(rounds + 1):
        out += f""",
a{r} as materialized (select vec_id, part, any_value(x) as x, min(struct_pack(d := d, entry := entry)) as best from (
    select vec_id, p.part, x, entry, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - c[i]) * (x[i] - c[i])))::bigint as d from p join b{r} on p.part = b{r}.part) group by vec_id, part)"""
        if r < rounds:
            out += f""",
m{r} as (select part, entry, list(mean order by place) as c from (select part, best.entry as entry, place, floor(sum(x[place])::double / count(*))::bigint as mean
    from a{r}, unnest(range(1, len(x) + 1)) as u(place) group by all) group by part, entry),
b{r + 1} as materialized (select b{r}.part, b{r}.entry, coalesce(m{r}.c, b{r}.c) as c from b{r} left join m{r} on m{r}.part = b{r}.part and m{r}.entry = b{r}.entry)"""
    return (
        out
        + f""",
coded as (select vec_id, string_agg(printf('%02x', best.entry), '' order by part) as code, sum(best.d)::bigint as error from a{rounds} group by vec_id),
labelled as (select vec_id, label, code, error from coded join kept using (vec_id))
select vec_id, code, error, (sum(error) over (partition by label))::bigint as label_error,
    (select sha256(string_agg(array_to_string(c, ','), ',' order by part, entry)) from b{rounds}) as codebooks_sha256 from labelled
"""
    )


#: DuckDB SQL for vec_id, code, error, label_error and codebooks_sha256, with the default parameters and unique vec_ids.
SQL = _sql()
