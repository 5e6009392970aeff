"""BM25: a stored index, scores for many queries at once, ranked hits, metadata filters.

The index is cut into slices of about a thousand documents, sorted by length within the part of the table that a task has read. A slice is one row: its documents,
their postings by term (64-bit hashes), the greatest count of each term, and which documents have which metadata value (tags, 64-bit hashes
of field and value). A built slice has its words too, so that texts are split into words once: document frequencies come from the slices. A search sends the asked terms and tags to all tasks, a block of queries at a time. A task bounds each query's score in a slice by
the terms' greatest counts and the shortest document; queries whose best k can't change are passed over, the others are
scored in numpy. So postings are never shuffled, frequent terms are no hot keys, and a task passes on k rows a query.

A query with tags has its best k among the documents with all of these, and its best k among all, from the same pass: where no document has them, the
filter can be relaxed without another search. Documents that share no term take part with a score of 0.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from lexiflume.config import DEFAULTS
from lexiflume.functions.text import tokens
from lexiflume.operators.topk import CELLS, Best
from lexiflume.sources.store import exists, scratch_path, stored_for

#: Queries that are sent to the tasks at once.
QUERY_BLOCK = 2048
#: Documents of a slice, and words of these, at most (a longer document is a slice of its own).
SLICE_DOCS, SLICE_WORDS = 1024, 1 << 20
#: Rows that a task passes on at once.
OUT_ROWS = 1 << 18
#: Goes up when what is stored changes: an index of another layout is not found again.
LAYOUT = 4
#: Spark decodes up to 4096 rows of a row group at once, and a slice has up to a million postings, which are far larger than what is stored of them.
_ROW_GROUPS = {"parquet.block.row.count.limit": "4"}
_TABLES = ("slices", "terms", "corpus")
_SLICE = {"doc_ids": "long", "lengths": "int", "terms": "long", "ends": "int", "docs": "int", "tfs": "int", "peaks": "int", "tags": "long", "tag_ends": "int", "tag_docs": "int"}
_SCHEMA = ", ".join(f"{name} array<{kind}>" for name, kind in _SLICE.items())


def tags(**values: Column | tuple[Column, bool]) -> Column:
    """Hashes of field names and values: null gives none, an array (marked by True) one for each element."""

    def each(name: str, v: Column, many: bool) -> Column:
        one = lambda x: F.xxhash64(F.lit(name), x.cast("string"))
        if many:
            return F.transform(F.array_compact(F.coalesce(v, F.array())), one)
        return F.array_compact(F.array(F.when(v.isNotNull(), one(v))))

    made = [each(name, *(v if isinstance(v, tuple) else (v, False))) for name, v in values.items()]
    return F.array_distinct(F.concat(*made)) if made else F.array().cast("array<long>")


def tags_of(df: DataFrame, fields: dict[str, str]) -> Column:
    """tags of a table: field name to column; array columns give one for each element."""
    kinds = dict(df.dtypes)
    return tags(**{name: (F.col(c), kinds[c].startswith("array")) for name, c in fields.items()})


def _ranges(first: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (counts[0] of them), first[1], ..."""
    return np.repeat(first - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())


def _grouped(keys: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, where each one's documents end, the documents, and how often each has the key."""
    order = np.lexsort((docs, keys))
    keys, docs = keys[order], docs[order]
    first = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1])])) if len(keys) else np.zeros(0, np.int64)
    counts = np.diff(np.append(first, len(keys)))
    keys, docs = keys[first], docs[first]
    starts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[starts], np.append(starts[1:], len(keys)) if len(keys) else starts, docs, counts


def _postings(words: pa.Array, docs: np.ndarray, n_docs: int) -> tuple:
    """_grouped of words by their hashes (Spark's xxhash64), and the distinct words in the order of these. A word is hashed once."""
    found = words.dictionary_encode()
    keys = np.array([xxhash.xxh64_intdigest(w, 42) for w in found.dictionary.cast(pa.binary()).to_pylist()], np.uint64).view(np.int64)
    order = np.argsort(keys)
    rank = np.empty(len(keys), np.int64)
    rank[order] = np.arange(len(keys))
    cells = np.sort(rank[found.indices.to_numpy()] * n_docs + docs)
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(cells)), bool), cells[1:] != cells[:-1]]))
    terms, docs = np.divmod(cells[first], n_docs)
    return keys[order], np.searchsorted(terms, np.arange(len(keys)), "right"), docs, np.diff(np.append(first, len(cells))), found.dictionary.take(pa.array(order))


def _slices(batches, most: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, words, tags), sorted by length, to slices of at most so many documents."""

    def made(parts) -> pa.RecordBatch:
        ids, lengths, n_tags, tag_keys = (np.concatenate(c) for c in zip(*(p[1:] for p in parts), strict=True))
        rows = np.arange(len(ids))
        terms, ends, docs, tfs, words = _postings(pa.concat_arrays([p[0] for p in parts]), np.repeat(rows, lengths), len(ids))
        peaks = np.maximum.reduceat(tfs, np.append(0, ends[:-1])) if len(ends) else tfs
        found, tag_ends, tag_docs, _ = _grouped(tag_keys, np.repeat(rows, n_tags))
        columns = (ids, lengths, terms, ends, docs, tfs, peaks, found, tag_ends, tag_docs)
        values = [*(pa.array(c.astype(np.int64 if kind == "long" else np.int32)) for c, kind in zip(columns, _SLICE.values(), strict=True)), words]
        return pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for v in values], [*_SLICE, "words"])

    parts, n_docs, n_words = [], 0, 0
    for b in batches:
        ids, words, marks = b.column("doc_id").to_numpy(), b.column("words"), b.column("tags")
        ends, mark_ends = words.offsets.to_numpy() - words.offsets[0].as_py(), marks.offsets.to_numpy() - marks.offsets[0].as_py()
        flat, flat_marks, at = words.flatten(), marks.flatten().to_numpy(), 0
        while at < len(ids):
            more = int(np.searchsorted(ends, ends[at] + SLICE_WORDS - n_words, "right")) - 1 - at
            more = min(len(ids) - at, most - n_docs, max(more, 0 if n_docs else 1))
            to = at + more
            if more:
                parts.append((flat[ends[at] : ends[to]], ids[at:to], np.diff(ends[at : to + 1]), np.diff(mark_ends[at : to + 1]), flat_marks[mark_ends[at] : mark_ends[to]]))
            n_docs, n_words, at = n_docs + more, n_words + int(ends[to] - ends[at]), to
            if not more or n_docs >= most or n_words >= SLICE_WORDS:
                yield made(parts)
                parts, n_docs, n_words = [], 0, 0
    if parts:
        yield made(parts)


class _Slice:
    """One row of the index as numpy arrays."""

    def __init__(self, batch: pa.RecordBatch, row: int):
        for name in _SLICE:
            setattr(self, name, batch.column(name)[row].values.to_numpy())
        self.starts = np.append(0, self.ends[:-1])[: len(self.ends)]

    def having(self, tag: int) -> np.ndarray:
        """Which documents have a tag."""
        out = np.zeros(len(self.doc_ids), bool)
        at = int(np.searchsorted(self.tags, tag))
        if at < len(self.tags) and self.tags[at] == tag:
            out[self.tag_docs[self.tag_ends[at - 1] if at else 0 : self.tag_ends[at]]] = True
        return out


class _Asked:
    """A block of queries: for each asked term's hash the queries that ask it and their weights; the tags that queries want."""

    def __init__(self, pairs: list[tuple[int, int, float]], wanted: list[list[int]], avgdl: float, k1: float, b: float):
        queries, keys, weights = (np.array([p[i] for p in pairs], kind) for i, kind in enumerate((np.int64, np.int64, float)))
        order = np.argsort(keys, kind="stable")
        self.terms, self.first = np.unique(keys[order], return_index=True)
        self.queries, self.weights = queries[order], weights[order]
        self.times = np.diff(np.append(self.first, len(keys)))
        self.n_queries, self.avgdl, self.k1, self.b, self.wanted = len(wanted), avgdl, k1, b, wanted
        self.filtered = np.array([q for q, t in enumerate(wanted) if t], np.int64)

    def parts(self, tfs: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
        """What a term adds, before its weight: greater for more occurrences and for shorter documents."""
        tf = tfs.astype(float)
        low = tf + self.k1 * (1 - self.b + self.b * (lengths / self.avgdl if self.avgdl > 0 else lengths))
        return tf * (self.k1 + 1) / np.where(low == 0, 1.0, low)

    def met(self, s: _Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, weight, place of the term in the slice) of the asked terms that the slice has."""
        if not len(s.terms) or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(s.terms, self.terms), len(s.terms) - 1)
        hit = np.flatnonzero(s.terms[at] == self.terms)
        pair = _ranges(self.first[hit], self.times[hit])
        return self.queries[pair], self.weights[pair], np.repeat(at[hit], self.times[hit])

    def bounds(self, s: _Slice, met) -> np.ndarray:
        """No document of the slice has a greater score: each term as often as in any, all in the shortest."""
        q, w, at = met
        return np.bincount(q, np.maximum(0, w) * self.parts(s.peaks[at], s.lengths.min()), self.n_queries)

    def scores(self, s: _Slice, met, rows: np.ndarray) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
        """Blocks of the rows (queries, ascending): which of them, their scores of all documents, and how many asked terms each shares."""
        q, w, at = met
        n = len(s.doc_ids)
        place = np.full(self.n_queries, -1)
        place[rows] = np.arange(len(rows))
        own = place[q] >= 0
        q, w, at = place[q[own]], w[own], at[own]
        counts = (s.ends - s.starts)[at]
        order = np.argsort(q, kind="stable")
        q, w, at, counts = q[order], w[order], at[order], counts[order]
        size = np.bincount(q, counts, len(rows)) + n  # postings and cells of each query
        block = (np.cumsum(size) // CELLS).astype(np.int64)
        for some in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(block)) + 1) if len(rows) else ():
            low, high = np.searchsorted(q, [some[0], some[-1] + 1])
            post = _ranges(s.starts[at[low:high]], counts[low:high])
            docs = s.docs[post]
            cell = np.repeat(q[low:high] - some[0], counts[low:high]) * n + docs
            part = self.parts(s.tfs[post], s.lengths[docs]) * np.repeat(w[low:high], counts[low:high])
            shape = (len(some), n)
            yield slice(some[0], some[-1] + 1), np.bincount(cell, part, shape[0] * n).reshape(shape), np.bincount(cell, minlength=shape[0] * n).reshape(shape)


class _Search:
    """The best k of a block of queries in a task, over all documents and over those that a query's tags allow."""

    def __init__(self, asked: _Asked, k: int, relax: bool):
        self.asked, self.all, self.filtered = asked, Best(asked.n_queries, k), Best(asked.n_queries, k)
        self.open = np.ones(asked.n_queries, bool)
        if not relax:
            self.open[asked.filtered] = False  # what the filter leaves is all that counts
        self.slices = self.untouched = self.scored = 0

    def add(self, s: _Slice) -> None:
        asked, n = self.asked, len(s.doc_ids)
        met = asked.met(s)
        bound = asked.bounds(s, met)
        go = self.open & ~self.all.closed(bound, s.doc_ids.min())
        masks, go_filtered = np.zeros((0, n), bool), np.zeros(0, np.int64)
        if len(asked.filtered):
            have: dict[int, np.ndarray] = {}
            masks = np.stack([np.logical_and.reduce([have[t] if t in have else have.setdefault(t, s.having(t)) for t in asked.wanted[q]]) for q in asked.filtered])
            least = np.where(masks, s.doc_ids, np.iinfo(np.int64).max).min(1)
            keys = np.zeros(asked.n_queries, np.int64)
            keys[asked.filtered] = least
            some = masks.any(1) & ~self.filtered.closed(bound, keys)[asked.filtered]
            masks, go_filtered = masks[some], asked.filtered[some]
        rows = np.flatnonzero(go | np.isin(np.arange(asked.n_queries), go_filtered))
        self.slices, self.untouched, self.scored = self.slices + 1, self.untouched + (not len(rows)), self.scored + len(rows)
        for part, scores, _ in asked.scores(s, met, rows):
            own = rows[part]
            self.all.add(s.doc_ids, scores[go[own]], own[go[own]])
            at = np.flatnonzero(np.isin(go_filtered, own))
            if len(at):
                self.filtered.add(s.doc_ids, np.where(masks[at], scores[np.searchsorted(own, go_filtered[at])], -np.inf), go_filtered[at])


@dataclass
class Bm25Index:
    """slices (see above), terms (term, key, df, idf), corpus (n, avgdl; one row)."""

    slices: DataFrame
    terms: DataFrame
    corpus: DataFrame
    epsilon: float = DEFAULTS.epsilon

    @staticmethod
    def build(docs: DataFrame, text_col: str = "text", epsilon: float = DEFAULTS.epsilon, fields: dict[str, str] | None = None, slice_docs: int = SLICE_DOCS) -> Bm25Index:
        """fields: metadata field to column of docs, for filters."""
        # Texts are sorted before they are split: a sort of words would hold many times their bytes.
        texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text_col).alias("text"), (tags_of(docs, fields) if fields else tags()).alias("tags"))
        words = texts.sortWithinPartitions(F.length("text"), "doc_id").select("doc_id", tokens("text").alias("words"), "tags")
        return Bm25Index.of(words.mapInArrow(lambda it: _slices(it, slice_docs), f"{_SCHEMA}, words array<string>"), epsilon)

    @staticmethod
    def of(slices: DataFrame, epsilon: float) -> Bm25Index:
        """The index of built slices, which know their words and their documents' lengths."""

        def counted(batches):
            for b in batches:
                for words, ends in zip(b.column("words"), b.column("ends"), strict=True):
                    yield pa.RecordBatch.from_arrays([words.values, pa.array(np.diff(ends.values.to_numpy(), prepend=0).astype(np.int64))], ["term", "df"])

        lengths = slices.select(F.size("doc_ids").alias("n"), F.aggregate("lengths", F.lit(0).cast("long"), lambda total, x: total + x).alias("words"))
        summed = lengths.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("words").alias("words"))
        corpus = summed.select("n", F.coalesce(F.try_divide("words", "n"), F.lit(0.0)).alias("avgdl"))
        df = slices.select("words", "ends").mapInArrow(counted, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")).crossJoin(F.broadcast(corpus.select("n")))  # one row
        raw = df.select("term", "df", (F.log(F.col("n") - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
        mean = raw.agg(F.avg("raw").alias("mean"))
        terms = raw.crossJoin(F.broadcast(mean)).select("term", F.xxhash64("term").alias("key"), "df", F.when(F.col("raw") < 0, epsilon * F.col("mean")).otherwise(F.col("raw")).alias("idf"))
        return Bm25Index(slices, terms, corpus, epsilon)

    def save(self, path: str) -> None:
        self.slices.write.mode("overwrite").options(**_ROW_GROUPS).parquet(f"{path}/slices")
        stored = Bm25Index.of(self.slices.sparkSession.read.parquet(f"{path}/slices"), self.epsilon)
        stored.corpus.write.mode("overwrite").parquet(f"{path}/corpus")
        stored.terms.write.mode("overwrite").parquet(f"{path}/terms")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Bm25Index:
        return Bm25Index(*(spark.read.parquet(f"{path}/{name}") for name in _TABLES))

    @staticmethod
    def stored(spark: SparkSession, table: str, prepare: Callable[[DataFrame], DataFrame] | None = None, fields: dict[str, str] | None = None) -> Bm25Index:
        """The index of a Parquet table (after prepare, which may add fields), built when there is none for its files and fields yet, below the shared
        folder."""
        make = lambda path: Bm25Index.build((prepare or (lambda df: df))(spark.read.parquet(table)), fields=fields).save(path)
        return Bm25Index.load(spark, stored_for(spark, table, f"bm25-{LAYOUT}", make, prepare, sorted((fields or {}).items())))

    @property
    def documents(self) -> DataFrame:
        """doc_id, dl."""
        return self.slices.select(F.explode(F.arrays_zip("doc_ids", "lengths")).alias("x")).select(F.col("x.doc_ids").alias("doc_id"), F.col("x.lengths").cast("long").alias("dl"))

    @property
    def postings(self) -> DataFrame:
        """term, doc_id, tf."""

        def flat(batches):
            for b in batches:
                for s in (_Slice(b, i) for i in range(b.num_rows)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(s.terms, s.ends - s.starts)), pa.array(s.doc_ids[s.docs]), pa.array(s.tfs.astype(np.int64))], ["key", "doc_id", "tf"])

        found = self.slices.select(*_SLICE).mapInArrow(flat, "key long, doc_id long, tf long")
        return found.join(self.terms.select("term", "key"), "key").select("term", "doc_id", "tf")

    def _each(self, queries: DataFrame, k1: float, b: float, work, schema: str) -> DataFrame:
        """work(ids, asked, slices) over the index for each block of queries: one block is a plan, several are written one after another."""
        spark = self.slices.sparkSession
        has_tags = "tags" in queries.columns
        n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
        asked = queries.select("query_id", F.explode(tokens("query")).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
        weighted = asked.join(self.terms, "term").groupBy("query_id").agg(F.collect_list(F.struct("key", (F.col("qtf") * F.col("idf")).alias("w"))).alias("asked"))
        every = queries.select(F.col("query_id").cast("long").alias("query_id"), (F.col("tags") if has_tags else F.array().cast("array<long>")).alias("tags")).dropDuplicates(["query_id"]).join(weighted, "query_id", "left")
        if n_blocks > 1:
            path = scratch_path(spark, "asked")
            every.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(n_blocks))).write.partitionBy("block").parquet(path)
            every = spark.read.parquet(path)
        avgdl, out = self.corpus.first().avgdl, scratch_path(spark, "found")
        for i in range(n_blocks):
            rows = (every.where(F.col("block") == i) if n_blocks > 1 else every).orderBy("query_id").collect()  # about QUERY_BLOCK
            if not rows:
                continue
            pairs = [(q, x.key, x.w) for q, r in enumerate(rows) for x in sorted(r.asked or [])]
            ids = np.array([r.query_id for r in rows], np.int64)
            sent = spark.sparkContext.broadcast(_Asked(pairs, [list(r.tags or ()) for r in rows], avgdl, k1, b))
            found = self.slices.select(*_SLICE).mapInArrow(lambda it, ids=ids, sent=sent: work(ids, sent.value, (_Slice(x, row) for x in it for row in range(x.num_rows))), schema)
            if n_blocks == 1:
                return found
            found.write.mode("append").parquet(out)
            sent.destroy()
        return spark.read.schema(schema).parquet(out) if exists(spark, out) else spark.createDataFrame([], schema)

    def scores(self, queries: DataFrame, k1: float = DEFAULTS.k1, b: float = DEFAULTS.b, every: bool = False) -> DataFrame:
        """query_id, doc_id, score of all documents that share a term; repeated query words count each time. queries may have tags: then only documents with
        all of them take part. every: documents without a shared term have score 0."""

        def all_of(ids, asked, slices):
            for s in slices:
                have: dict[int, np.ndarray] = {}
                for part, score, shared in asked.scores(s, asked.met(s), np.arange(len(ids))):
                    some = np.ones(score.shape, bool) if every else shared > 0
                    for row, q in enumerate(range(part.start, part.stop)):
                        for t in asked.wanted[q]:
                            some[row] &= have[t] if t in have else have.setdefault(t, s.having(t))
                    q, d = np.nonzero(some)
                    for at in range(0, len(q), OUT_ROWS):
                        few = slice(at, at + OUT_ROWS)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[part][q[few]]), pa.array(s.doc_ids[d[few]]), pa.array(score[q[few], d[few]])], ["query_id", "doc_id", "score"])

        return self._each(queries, k1, b, all_of, "query_id long, doc_id long, score double")

    def search(self, queries: DataFrame, k: int = DEFAULTS.bm25_candidates, relax: bool = True) -> DataFrame:
        """query_id, doc_id, score, bm25_rank, filter_relaxed: the best k for each query, ties by doc_id. Documents without a shared term
        have score 0 and fill up. queries (query_id, query) may have tags: then only documents with all of them take part; where there is
        none and relax is set, all do, and filter_relaxed says so (F04)."""

        def best_of(ids, asked, slices):
            found = _Search(asked, k, relax)
            for s in slices:
                found.add(s)
            wanted = np.isin(np.arange(len(ids)), asked.filtered)
            for best, kind in ((found.all, False), (found.filtered, True)):
                b = best.batch(ids, ("query_id", "doc_id", "score"))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(np.full(b.num_rows, kind)), pa.array(np.repeat(wanted, [len(x) for x in best.keys]))], [*b.schema.names, "matched", "wanted"])

        full = self._each(queries, DEFAULTS.k1, DEFAULTS.b, best_of, "query_id long, doc_id long, score double, matched boolean, wanted boolean")
        per = Window.partitionBy("query_id")
        if "tags" in queries.columns:
            full = full.withColumn("some", F.max("matched").over(per)).where("matched = some")
        by = per.orderBy(F.round("score", 6).desc(), "doc_id")
        ranked = full.withColumn("bm25_rank", F.row_number().over(by)).where(F.col("bm25_rank") <= k)
        return ranked.select("query_id", "doc_id", "score", "bm25_rank", (F.col("wanted") & ~F.col("matched")).alias("filter_relaxed"))

    def scanned(self, queries: DataFrame, k: int = DEFAULTS.bm25_candidates) -> DataFrame:
        """slices, untouched (no query had to be scored in these), pairs (of query and slice) and scored (pairs that had to be scored) of a search."""

        def count(ids, asked, slices):
            found = _Search(asked, k, True)
            for s in slices:
                found.add(s)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (found.slices, found.untouched, found.slices * len(ids), found.scored)], ["slices", "untouched", "pairs", "scored"])

        seen = self._each(queries, DEFAULTS.k1, DEFAULTS.b, count, "slices long, untouched long, pairs long, scored long")
        return seen.agg(*[F.sum(c).alias(c) for c in ("slices", "untouched", "pairs", "scored")])


#: DuckDB: postings, lengths, corpus figures and terms over documents(doc_id, text), then scores of questions.
SQL = r"""tok as materialized (select doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) as term from documents),
postings as materialized (select term, doc_id, count(*) as tf from tok group by all),
lengths as (select d.doc_id, coalesce(x.dl, 0) as dl from documents d left join (select doc_id, count(*) as dl from tok group by 1) x using (doc_id)),
corpus as (select count(*) as n, coalesce(avg(dl), 0) as avgdl from lengths),
raw as materialized (select term, count(*) as df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) as raw from postings, corpus group by term),
terms as materialized (select term, df, case when raw < 0 then 0.25 * (select avg(raw) from raw) else raw end as idf from raw)"""


def scores_sql(source: str, key: str, text: str) -> str:
    """Common table expressions asked and scored for the queries of a table."""
    return rf"""asked as (select {key} as query_id, term, count(*) as qtf from (select {key}, unnest(regexp_extract_all(lower({text}), '[\p{{L}}\p{{N}}_]+')) as term from {source}) group by all),
scored as (select query_id, doc_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))) as score
    from asked join terms using (term) join postings using (term) join lengths using (doc_id), corpus group by all)"""


SCORES = f"{SQL},\n{scores_sql('benchmark', 'item_id', 'text')}"
RANKED = (
    SCORES
    + """,
everything as (select b.item_id as query_id, d.doc_id, coalesce(s.score, 0) as score from benchmark b cross join documents d left join scored s on s.query_id = b.item_id and s.doc_id = d.doc_id),
hits as (select * from (select *, row_number() over (partition by query_id order by round(score, 6) desc, doc_id) as bm25_rank from everything) where bm25_rank <= 100)"""
)
