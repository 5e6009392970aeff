"""Vectors: unit vectors, cosine, exact nearest neighbours of query blocks, pooling."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F, types as T

from lexiflume.operators.topk import CELLS, Best
from lexiflume.sources.store import kept, scratch_path, stored_for

#: Query vectors that one pass over the corpus holds.
QUERY_BLOCK = 4096


def as_double(c: str) -> Column:
    return F.col(c).cast("array<double>")


def dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(c: str) -> Column:
    return F.sqrt(F.aggregate(as_double(c), F.lit(0.0), lambda s, x: s + x * x))


def unit(c: str) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(c)
    return F.when(n > 0, F.transform(as_double(c), lambda x: x / n)).otherwise(as_double(c))


def cosine(a: str, b: str) -> Column:
    both = norm(a) * norm(b)
    return F.when(both > 0, dot(a, b) / both).otherwise(F.lit(0.0))


def _rows(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit_rows(rows: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(n > 0, n, 1)


@dataclass
class _Block:
    """Queries with vectors of one length that are sent to the tasks at once."""

    ids: np.ndarray
    rows: np.ndarray
    tags: list[list[int]]
    metric: str

    def __post_init__(self):
        self.dim = self.rows.shape[1]
        self.used = _unit_rows(self.rows) if self.metric == "cosine" else self.rows
        self.zero = ~self.rows.any(1)

    def scores(self, c: np.ndarray) -> np.ndarray:
        if self.metric == "cosine":
            return self.used @ _unit_rows(c).T
        q = self.used
        return np.maximum(0, 1 - ((q * q).sum(1)[:, None] - 2 * q @ c.T + (c * c).sum(1)))


def _blocks(queries: DataFrame, metric: str) -> Iterator[_Block]:
    """Null vectors take no part, and vectors of another length do not meet."""
    has_tags = "tags" in queries.columns
    sized = queries.where("embedding is not null").select("query_id", "embedding", F.size("embedding").alias("dim"), (F.col("tags") if has_tags else F.array().cast("array<long>")).alias("tags"))
    for dim, n in sorted((r.dim, r.n) for r in sized.groupBy("dim").agg(F.count("*").alias("n")).where("dim > 0").collect()):  # one row for each length
        n_blocks = -(-n // QUERY_BLOCK)
        for block in range(n_blocks):
            some = sized.where((F.col("dim") == dim) & (F.pmod(F.xxhash64("query_id"), F.lit(n_blocks)) == block)).orderBy("query_id").toArrow()
            if some.num_rows:
                yield _Block(some.column("query_id").to_numpy(), _rows(some.column("embedding").combine_chunks(), dim), [t or [] for t in some.column("tags").to_pylist()], metric)


def _gathered(spark, plans: Iterator[DataFrame], schema: str) -> DataFrame:
    """The rows of all plans: one is left as it is, several are written one after another, so that one broadcast at a time is in use."""
    first = next(plans, None)
    second = next(plans, None) if first is not None else None
    if second is None:
        return first if first is not None else spark.createDataFrame([], schema)
    path = scratch_path(spark, "met")
    for p in (first, second, *plans):
        p.write.mode("append").parquet(path)
    return spark.read.schema(schema).parquet(path)


def _met(queries: DataFrame, corpus: DataFrame, metric: str, work, schema: str) -> DataFrame:
    """work(block, slices (keys, vectors, tags)) over the corpus for each block of queries; a slice's scores stay within CELLS."""
    spark = corpus.sparkSession
    columns = ["vec_id", "embedding", *[c for c in ("tags",) if c in corpus.columns]]

    def plan(block: _Block) -> DataFrame:
        sent = spark.sparkContext.broadcast(block)
        fitting = corpus.where(F.col("embedding").isNotNull() & (F.size("embedding") == block.dim)).select(*columns)

        def slices(batches):
            step = max(1, CELLS // len(sent.value.ids))
            for whole in batches:
                for at in range(0, whole.num_rows, step):
                    b = whole.slice(at, step)
                    yield b.column("vec_id").to_numpy(), _rows(b.column("embedding"), sent.value.dim), b.column("tags") if "tags" in columns else None

        return fitting.mapInArrow(lambda it: work(sent.value, slices(it)), schema)

    return _gathered(spark, map(plan, _blocks(queries, metric)), schema)


class _Near:
    """The best k of a block of queries in a task, over all vectors and over those that a query's tags allow."""

    def __init__(self, block: _Block, k: int, relax: bool):
        self.block, n = block, len(block.ids)
        self.all, self.filtered, self.relax = Best(n, k), Best(n, k), relax
        self.wanted = np.array([bool(t) for t in block.tags])
        self.slices = self.untouched = self.scored = 0

    def masks(self, tag_column: pa.Array | None, n: int) -> np.ndarray:
        """Of each query with tags: which vectors have all of these."""
        asked = [self.block.tags[q] for q in np.flatnonzero(self.wanted)]
        if tag_column is None:
            return np.zeros((len(asked), n), bool)
        ends, flat = tag_column.offsets.to_numpy(), tag_column.flatten().to_numpy()
        row = np.repeat(np.arange(n), np.diff(ends))
        known = {}
        for t in {t for x in asked for t in x}:
            known[t] = np.zeros(n, bool)
            known[t][row[flat == t]] = True
        return np.stack([np.logical_and.reduce([known[t] for t in x]) for x in asked])

    def add(self, keys: np.ndarray, vectors: np.ndarray, tag_column: pa.Array | None, bound: np.ndarray | None = None) -> None:
        """bound: no vector of the slice has a greater score."""
        n = len(self.wanted)
        bound = np.full(n, np.inf) if bound is None else bound
        go = ~self.all.closed(bound, keys.min(initial=np.iinfo(np.int64).max))
        if not self.relax:
            go &= ~self.wanted
        go_filtered = self.wanted & ~self.filtered.closed(bound, np.iinfo(np.int64).min)
        rows = np.flatnonzero(go | go_filtered)
        self.slices, self.untouched, self.scored = self.slices + 1, self.untouched + (not len(rows)), self.scored + len(rows)
        if not len(rows) or not len(keys):
            return
        some = _Block(self.block.ids[rows], self.block.rows[rows], [], self.block.metric) if len(rows) < n else self.block
        scores = np.round(some.scores(vectors), 6) + 0.0  # ties by id, as in the final ranking
        self.all.add(keys, scores[go[rows]], rows[go[rows]])
        if go_filtered.any():
            masks = self.masks(tag_column, len(keys))[go_filtered[self.wanted]]
            self.filtered.add(keys, np.where(masks, scores[go_filtered[rows]], -np.inf), np.flatnonzero(go_filtered))

    def batches(self) -> Iterator[pa.RecordBatch]:
        for best, kind in ((self.all, False), (self.filtered, True)):
            b = best.batch(self.block.ids, ("query_id", "vec_id", "score"))
            wanted = np.repeat(self.wanted, [len(x) for x in best.keys])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, kind)), pa.array(wanted)], [*b.schema.names, "matched", "wanted"])

    def counts(self) -> pa.RecordBatch:
        numbers = (self.slices, self.untouched, self.slices * len(self.wanted), self.scored)
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in numbers], list(_COUNTS))


_FOUND = "query_id long, vec_id long, score double, matched boolean, wanted boolean"
_COUNTS = ("slices", "untouched", "pairs", "scored")


def _ranked(found: DataFrame, k: int, with_tags: bool) -> DataFrame:
    per = Window.partitionBy("query_id")
    if with_tags:
        found = found.withColumn("some", F.max("matched").over(per)).where("matched = some")
    out = found.withColumn("rank", F.row_number().over(per.orderBy(F.desc("score"), "vec_id"))).where(F.col("rank") <= k)
    return out.select("query_id", "vec_id", "score", "rank", *([(F.col("wanted") & ~F.col("matched")).alias("filter_relaxed")] if with_tags else []))


def nearest(queries: DataFrame, corpus: DataFrame, k: int, metric: str = "cosine", relax: bool = False) -> DataFrame:
    """queries (query_id, embedding) against corpus (vec_id, embedding): query_id, vec_id, score, rank of the best k.

    Queries go in blocks; a slice of the corpus meets a block in one matrix product, and a task passes on its best k for each
    query. Null vectors are left out, and vectors meet those of their own length only; zero vectors have cosine 0. With tags on both sides
    (array<long>) a query meets the vectors that have all of its tags; where there is none and relax is set, all of them, and filter_relaxed says so."""

    def search(block, slices):
        near = _Near(block, k, relax)
        for s in slices:
            near.add(*s)
        yield from near.batches()

    return _ranked(_met(queries, corpus, metric, search, _FOUND), k, "tags" in queries.columns)


@dataclass
class VectorIndex:
    """Vectors in slices around pivots, for exact search that passes slices over.

    Pivots are a sample of the vectors (as many as the square root of their number, at most PIVOTS). Each vector belongs to its nearest pivot; vectors of one
    pivot are sorted by their distance to it and cut into slices of at most SLICE, which know the least and the greatest distance. By the triangle
    inequality a query's distance to a slice's vectors is at least what its distance to the pivot leaves, which bounds their scores; slices
    that can't change the best k are not scored. Since pivots are vectors of the corpus, a query's k-th best pivot is where its search starts from.
    Zero vectors have slices of their own."""

    #: slices: dim, centre, low, high, ids, vectors (one after another), tags and how many tags each vector has.
    slices: DataFrame
    #: vec_id, embedding, tags of the pivots.
    pivots: DataFrame
    metric: str = "cosine"

    #: LAYOUT goes up when what is stored changes.
    PIVOTS, SLICE, LAYOUT = 1024, 512, 1
    _SCHEMA = "dim int, centre array<double>, low double, high double, ids array<long>, vectors array<double>, tags array<long>, n_tags array<int>"

    @staticmethod
    def build(corpus: DataFrame, metric: str = "cosine", slice_size: int = SLICE) -> VectorIndex:
        """corpus (vec_id, embedding) and maybe tags."""
        spark = corpus.sparkSession
        tags = F.coalesce("tags", F.array().cast("array<long>")) if "tags" in corpus.columns else F.array().cast("array<long>")
        rows = corpus.where("embedding is not null and size(embedding) > 0").select(F.col("vec_id").cast("long").alias("vec_id"), as_double("embedding").alias("embedding"), tags.alias("tags"))
        n = max(1, min(VectorIndex.PIVOTS, int(rows.count() ** 0.5)))
        pivots = rows.where(norm("embedding") > 0).orderBy(F.xxhash64("vec_id"), "vec_id").limit(n)
        pivots = kept(pivots)
        sent = spark.sparkContext.broadcast([(p.vec_id, np.array(p.embedding)) for p in pivots.collect()])  # at most PIVOTS
        cosine_ = metric == "cosine"

        def assigned(batches):
            centres: dict[int, np.ndarray] = {}
            for _, v in sent.value:
                centres.setdefault(len(v), []).append(v)
            centres = {d: _unit_rows(np.stack(c)) if cosine_ else np.stack(c) for d, c in centres.items()}
            for b in batches:
                column = b.column("embedding")
                lengths = np.diff(column.offsets.to_numpy())
                pivot, distance = np.full(len(lengths), -1), np.zeros(len(lengths))
                for d in np.unique(lengths):
                    at = np.flatnonzero(lengths == d)
                    if d in centres:
                        c, x = centres[d], _rows(column.take(pa.array(at)), d)
                        x = _unit_rows(x) if cosine_ else x
                        square = (x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)
                        pivot[at] = square.argmin(1)
                        distance[at] = np.linalg.norm(x - c[pivot[at]], axis=1)
                        pivot[at[~x.any(1)]] = -1
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(lengths, pa.int32()), pa.array(pivot, pa.int32()), pa.array(distance)], [*b.schema.names, "dim", "pivot", "distance"])

        placed = rows.mapInArrow(assigned, "vec_id long, embedding array<double>, tags array<long>, dim int, pivot int, distance double")
        # A hash ends the key, so that one vector many times over is spread over several ranges.
        dealt = placed.repartitionByRange(F.col("dim"), F.col("pivot"), F.col("distance"), F.xxhash64("vec_id")).sortWithinPartitions("dim", "pivot", "distance", "vec_id")

        def cut(batches):
            by_dim: dict[int, list] = {}
            for _, v in sent.value:
                by_dim.setdefault(len(v), []).append(v)
            for b in batches:
                dim, pivot, distance = (b.column(c).to_numpy() for c in ("dim", "pivot", "distance"))
                edge = np.flatnonzero((dim[1:] != dim[:-1]) | (pivot[1:] != pivot[:-1])) + 1
                starts = np.concatenate([np.arange(x, y, slice_size) for x, y in zip(np.append(0, edge), np.append(edge, len(dim)), strict=True)]) if len(dim) else []
                for x, y in zip(starts, [*starts[1:], len(dim)], strict=True):
                    part = b.slice(x, y - x)
                    centre = by_dim[dim[x]][pivot[x]].tolist() if pivot[x] >= 0 else None
                    n_tags = np.diff(part.column("tags").offsets.to_numpy())
                    row = {"dim": dim[x], "centre": centre, "low": distance[x], "high": distance[y - 1], "ids": part.column("vec_id").to_numpy(), "vectors": part.column("embedding").flatten().to_numpy(), "tags": part.column("tags").flatten().to_numpy(), "n_tags": n_tags}
                    kinds = (pa.int32(), pa.list_(pa.float64()), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([pa.array([v], kind) for v, kind in zip(row.values(), kinds, strict=True)], list(row))

        return VectorIndex(dealt.mapInArrow(cut, VectorIndex._SCHEMA), pivots, metric)

    def save(self, path: str) -> None:
        self.slices.write.mode("overwrite").parquet(f"{path}/slices")
        self.pivots.write.mode("overwrite").parquet(f"{path}/pivots")

    @staticmethod
    def load(spark: SparkSession, path: str, metric: str = "cosine") -> VectorIndex:
        return VectorIndex(spark.read.parquet(f"{path}/slices"), spark.read.parquet(f"{path}/pivots"), metric)

    @staticmethod
    def stored(spark: SparkSession, table: str, metric: str = "cosine", prepare: Callable[[DataFrame], DataFrame] | None = None) -> VectorIndex:
        """The index of a Parquet table (vec_id, embedding; after prepare), built when there is none for its files yet."""
        where = stored_for(spark, table, f"vectors-{VectorIndex.LAYOUT}-{metric}", lambda path: VectorIndex.build((prepare or (lambda df: df))(spark.read.parquet(table)), metric).save(path), prepare)
        return VectorIndex.load(spark, where, metric)

    def _each(self, queries: DataFrame, k: int, relax: bool, last, schema: str) -> DataFrame:
        spark = self.slices.sparkSession
        pivots = self.pivots.collect()  # at most PIVOTS

        def plan(block: _Block) -> DataFrame:
            own = np.stack([p.embedding for p in pivots if len(p.embedding) == block.dim] or [np.zeros(block.dim)])[: len(pivots)]
            floor = np.full(len(block.ids), -np.inf)
            if sum(len(p.embedding) == block.dim for p in pivots) >= k > 0:
                floor = np.round(-np.partition(-block.scores(own), k - 1, axis=1)[:, k - 1], 6)
            sent = spark.sparkContext.broadcast((block, floor))

            def work(batches):
                block, floor = sent.value
                near = _Near(block, k, relax)
                near.all.start(floor)
                for b in batches:
                    for i in range(b.num_rows):
                        at = {c: b.column(c)[i] for c in b.schema.names}
                        near.add(at["ids"].values.to_numpy(), at["vectors"].values.to_numpy().reshape(-1, block.dim), _listed(at["tags"].values, at["n_tags"].values), _bound(block, at))
                yield from last(near)

            return self.slices.where(F.col("dim") == block.dim).mapInArrow(work, schema)

        return _gathered(spark, map(plan, _blocks(queries, self.metric)), schema)

    def search(self, queries: DataFrame, k: int, relax: bool = False) -> DataFrame:
        """What nearest gives for the same vectors."""
        return _ranked(self._each(queries, k, relax, _Near.batches, _FOUND), k, "tags" in queries.columns)

    def scanned(self, queries: DataFrame, k: int) -> DataFrame:
        """slices, untouched (no query had to be scored in these), pairs (of query and slice) and scored (pairs that had to be scored) of a search."""
        seen = self._each(queries, k, True, lambda near: [near.counts()], ", ".join(f"{c} long" for c in _COUNTS))
        return seen.agg(*[F.sum(c).alias(c) for c in _COUNTS])


def _listed(flat: pa.Array, counts: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts.to_numpy())).astype(np.int32)), flat)


def _bound(block: _Block, row: dict) -> np.ndarray:
    """Greatest score that a query can have with a vector of a slice."""
    if not row["centre"].is_valid:  # zero vectors
        return np.zeros(len(block.ids)) if block.metric == "cosine" else np.maximum(0, 1 - (block.rows**2).sum(1))
    centre = row["centre"].values.to_numpy()[None, :]
    centre = _unit_rows(centre) if block.metric == "cosine" else centre
    d = np.linalg.norm(block.used - centre, axis=1)
    least = np.maximum(0, np.maximum(d - row["high"].as_py(), row["low"].as_py() - d) - 1e-9)  # more than rounding errors
    if block.metric == "cosine":
        return np.where(block.zero, 0.0, 1 - least**2 / 2 + 1e-9)
    return np.maximum(0, 1 - least**2) + 1e-9


def similarity_stats(queries: DataFrame, corpus: DataFrame, metric: str = "cosine", others_only: bool = False) -> DataFrame:
    """query_id, n, total, best: number, sum and maximum of each query's similarities to the whole corpus (V09), or to the vectors
    with another id (J11); a task adds its own up."""

    def add(block, slices):
        ids = block.ids
        n, total, best = np.zeros(len(ids), np.int64), np.zeros(len(ids)), np.full(len(ids), -np.inf)
        for keys, vectors, _ in slices:
            scores = block.scores(vectors)
            own = (keys == ids[:, None]) if others_only else np.zeros((1, len(keys)), bool)
            n, total = n + (~own).sum(1), total + np.where(own, 0, scores).sum(1)
            best = np.maximum(best, np.where(own, -np.inf, scores).max(1))
        some = n > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (ids, n, total, best)], ["query_id", "n", "total", "best"])

    parts = _met(queries, corpus, metric, add, "query_id long, n long, total double, best double")
    return parts.groupBy("query_id").agg(F.sum("n").alias("n"), F.sum("total").alias("total"), F.max("best").alias("best"))


def _collected(cells: DataFrame, *key: str) -> DataFrame:
    """cells (key, i, x): a vector for each key."""
    return cells.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("embedding"))


def pooled(token_vectors: DataFrame, how: str = "average", normalise: bool = False) -> DataFrame:
    """doc_id, embedding of token vectors (doc_id, pos, mask, embedding): the mean of the tokens with a mask of 1, or the first token's
    vector (zero if masked) for "cls"; at length 1 if asked (V06). Documents without an unmasked token have no mean."""
    if how == "cls":
        first = token_vectors.groupBy("doc_id").agg(F.min_by(F.struct("mask", "embedding"), "pos").alias("t"))
        out = first.select("doc_id", F.transform(F.col("t.embedding").cast("array<double>"), lambda x: x * F.col("t.mask")).alias("embedding"))
    elif how == "average":
        cells = token_vectors.where("mask = 1").select("doc_id", F.posexplode("embedding").alias("i", "x")).groupBy("doc_id", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
        out = _collected(cells, "doc_id")
    else:
        raise ValueError(f"unknown pooling: {how}")
    return out.select("doc_id", unit("embedding").alias("embedding")) if normalise else out


#: Positions of a document whose running sums one task makes.
RUN = 4096


def _running(batches) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, block, pos, kind, span, edge, embedding), sorted by (doc_id, block, pos, kind), to running sums within each block: one for each mark (kind 0: the sum of the
    vectors before it), and one for the whole block, without a span. The state is one vector."""
    now, total, n, out = None, None, 0, []

    def closed():
        if now is not None and n:
            out.append((now[0], now[1], None, None, n, total.tolist()))

    for b in batches:
        columns = [b.column(c).to_pylist() for c in ("doc_id", "block", "kind", "span", "edge")]
        vectors, flat = b.column("embedding"), None
        flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float)
        ends = np.cumsum(pc.fill_null(pc.list_value_length(vectors), 0).to_numpy())
        for i, (doc, block, kind, span, edge) in enumerate(zip(*columns, strict=True)):
            if now != (doc, block):
                closed()
                now, total, n = (doc, block), None, 0
            if kind:
                v = flat[ends[i - 1] if i else 0 : ends[i]]
                total, n = v.copy() if total is None else total + v, n + 1
            else:
                out.append((doc, block, span, edge, n, None if total is None else total.tolist()))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "block", "span", "edge", "n", "total"), r, strict=True)) for r in out], schema=_RUNNING)
            out.clear()
    closed()
    if out:
        yield pa.RecordBatch.from_pylist([dict(zip(("doc_id", "block", "span", "edge", "n", "total"), r, strict=True)) for r in out], schema=_RUNNING)


def _carried(batches) -> Iterator[pa.RecordBatch]:
    """The same sums, sorted by (doc_id, block, marks first), with those of the document's blocks before added; marks only."""
    doc, total, n = object(), None, 0
    for b in batches:
        out = []
        for r in b.to_pylist():
            if r["doc_id"] != doc:
                doc, total, n = r["doc_id"], None, 0
            own = None if r["total"] is None else np.array(r["total"])
            both = own if total is None else total if own is None else total + own
            if r["edge"] is None:
                total, n = both, n + r["n"]
            else:
                out.append(r | {"n": n + r["n"], "total": None if both is None else both.tolist()})
        yield pa.RecordBatch.from_pylist(out, schema=_RUNNING)


_RUNNING = pa.schema([("doc_id", pa.string()), ("block", pa.int64()), ("span", pa.string()), ("edge", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.float64()))])


def pooled_spans(token_vectors: DataFrame, spans: DataFrame, max_length: int | None = None) -> DataFrame:
    """Late chunking: the unit mean of the token vectors (doc_id, pos, embedding) in each span (doc_id, span, start,
    end), end exclusive and clipped to max_length - 1; spans without tokens give no row. Spans may overlap, and repeat.

    A span's sum is the difference of two running sums, so each token is read once, however many spans hold it. Running sums are made for blocks of RUN positions
    by tasks of their own, then a document's blocks, one vector each, are added up in order. Token vectors are shuffled once."""
    key, name = spans.schema["doc_id"].dataType.simpleString(), spans.schema["span"].dataType.simpleString()
    end = F.least(F.col("end"), F.lit(max_length - 1)) if max_length else F.col("end")
    marked = spans.where(F.col("start") < end).select(F.col("doc_id").cast("string").alias("doc_id"), F.col("span").cast("string").alias("span"), F.explode(F.array(F.struct(F.col("start").cast("long").alias("pos"), F.lit(0).alias("edge")), F.struct(end.cast("long").alias("pos"), F.lit(1).alias("edge")))).alias("m"))
    marked = marked.select("doc_id", "span", "m.pos", "m.edge", F.lit(0).alias("kind"), F.lit(None).cast("array<double>").alias("embedding"))
    tokens = token_vectors.select(F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("string").alias("span"), F.col("pos").cast("long").alias("pos"), F.lit(None).cast("int").alias("edge"), F.lit(1).alias("kind"), as_double("embedding").alias("embedding"))
    both = marked.unionByName(tokens).withColumn("block", F.floor(F.col("pos") / RUN).cast("long"))
    schema = "doc_id string, block long, span string, edge int, n long, total array<double>"
    within = both.repartition("doc_id", "block").sortWithinPartitions("doc_id", "block", "pos", "kind").select("doc_id", "block", "kind", "span", "edge", "embedding").mapInArrow(_running, schema)
    sums = within.repartition("doc_id").sortWithinPartitions("doc_id", "block", F.col("edge").isNull()).mapInArrow(_carried, schema)
    ends = sums.groupBy("doc_id", "span").agg(*[F.max(F.when(F.col("edge") == e, F.struct("n", "total"))).alias(c) for e, c in ((0, "a"), (1, "z"))])
    zero = F.transform("z.total", lambda x: F.lit(0.0))
    mean = F.zip_with("z.total", F.coalesce("a.total", zero), lambda z, a: (z - a) / (F.col("z.n") - F.col("a.n")))
    out = ends.where("z.n > a.n").select(F.col("doc_id").cast(key).alias("doc_id"), F.col("span").cast(name).alias("span"), mean.alias("embedding"))
    return out.select("doc_id", "span", unit("embedding").alias("embedding"))


def _pooled(part: pa.Table, rows: Callable[[pa.Table, int, int], np.ndarray]) -> pa.RecordBatch:
    """The chunks of one batch with their spans and the unit means of these, RUN token vectors at a time."""
    n = pc.fill_null(part.column("n_tokens"), 0).to_numpy().astype(np.int64)
    end = np.cumsum(n)
    start, some = end - n, np.flatnonzero(n > 0)
    total = np.zeros((len(n), 0))
    for first in range(0, int(end[-1]), RUN):
        last = min(first + RUN, int(end[-1]))
        v = rows(part, first, last)
        here = some[(start[some] < last) & (end[some] > first)]
        total = total if total.size else np.zeros((len(n), v.shape[1]))
        total[here] += np.add.reduceat(v, np.maximum(start[here], first) - first, axis=0)
    mean = total[some] / n[some, None]
    size = np.sqrt((mean * mean).sum(1))
    mean /= np.where(size > 0, size, 1)[:, None]
    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1) * mean.shape[1], pa.int32()), pa.array(mean.ravel()))
    return pa.RecordBatch.from_arrays([part.column("chunk_id").combine_chunks().take(pa.array(some)), part.column("batch_id").combine_chunks().take(pa.array(some)), pa.array(start[some]), pa.array(end[some]), lists], ["chunk_id", "batch_id", "start", "end", "embedding"])


def late_ingest(chunks: DataFrame, embed_tokens: Callable[[DataFrame], DataFrame] | None = None, budget: int = 8192, group: str = "source", order: str = "doc_id", rows: Callable[[pa.Table, int, int], np.ndarray] | None = None) -> DataFrame:
    """Late-chunk ingest (R20): chunks (chunk_id, group, order, n_tokens) are packed in order into batches of a token budget, a batch is
    embedded as one text, and each chunk's vector is the unit mean of its own span of token vectors. Returns chunk_id, batch_id, start, end, embedding; chunks without
    tokens give no row.

    embed_tokens takes packed chunks (batch_id, pos, chunk_id, n_tokens) and returns (doc_id = batch_id, pos, embedding), a row for each token. rows turns a batch's chunks
    (a table with all their columns) and two positions into the token vectors from the first position to before the last, within the task that has the batch: then no token
    vector is shuffled, and a task holds RUN of them."""
    from lexiflume.operators.chunking import pack_batches

    packed = pack_batches(chunks.withColumn("_n", F.col("n_tokens") + 2), group, order, "_n", budget)
    packed = packed.withColumn("batch_id", F.xxhash64(group, "batch"))
    if rows:

        def pool(batches):
            held: list[pa.RecordBatch] = []
            last = None
            for b in batches:
                ids = b.column("batch_id").to_numpy()
                cuts = [0, *(np.flatnonzero(ids[1:] != ids[:-1]) + 1).tolist(), len(ids)]
                for a, z in zip(cuts[:-1], cuts[1:], strict=True):
                    if a == z:
                        continue
                    if held and ids[a] != last:
                        yield _pooled(pa.Table.from_batches(held), rows)
                        held = []
                    held.append(b.slice(a, z - a))
                    last = ids[a]
            if held:
                yield _pooled(pa.Table.from_batches(held), rows)

        # A number of tasks: the optimizer would join the rows, few bytes each, into one or two tasks.
        tasks = int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        dealt = packed.repartition(tasks, "batch_id").sortWithinPartitions("batch_id", order)
        return dealt.mapInArrow(pool, T.StructType([chunks.schema["chunk_id"], *(T.StructField(c, T.LongType()) for c in ("batch_id", "start", "end")), T.StructField("embedding", T.ArrayType(T.DoubleType()))]))
    before = Window.partitionBy("batch_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    spans = packed.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))).withColumn("end", F.col("start") + F.col("n_tokens"))
    pieces = embed_tokens(spans.select("batch_id", "start", "chunk_id", "n_tokens"))
    wanted = spans.select(F.col("batch_id").alias("doc_id"), F.col("chunk_id").alias("span"), "start", "end")
    vectors = pooled_spans(pieces, wanted).select(F.col("span").alias("chunk_id"), "embedding")
    return spans.select("chunk_id", "batch_id", "start", "end").join(vectors, "chunk_id")
