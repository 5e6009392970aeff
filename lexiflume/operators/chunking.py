"""Chunkers: Markdown headers, clause packing, fixed windows, sentences, similarity drops."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from lexiflume.config import DEFAULTS
from lexiflume.functions.text import bound, tokens
from lexiflume.operators.vectors import cosine
from lexiflume.sources.store import kept

# Header marks and the metadata they set.
LEVELS = {"source": 1, "chapter": 2, "section": 3, "article": 4}
#: What is left of a line that is a header, or would be one without the backslashes before its marks.
_HEADER = r"#{1,4}[\s&&[^\n]]+[^\s]"


def as_body(text: Column | str) -> Column:
    """A text as the body of a Markdown section: lines that would be headers get a backslash before their marks (header_split takes it off again, if literal)."""
    return F.regexp_replace(text, rf"(?md)^(?=\\*{_HEADER})", r"\\")


def header_split(docs: DataFrame, text_col: str = "text", literal: bool = False) -> DataFrame:
    """doc_id, part, source, chapter, section, article, content: runs of lines under the same headers; a header resets the
    deeper ones (C01). A document's lines are one ordered group. Runs of blank lines are left out. literal: bodies are texts as as_body makes them, whatever they
    hold; their backslashes are taken off, and a blank text is a run as well."""
    lines = docs.select("doc_id", F.posexplode(F.split(text_col, "\n")).alias("pos", "line"))
    mark = F.regexp_extract("line", r"^(#{1,4})\s+\S", 1)
    line = F.regexp_replace("line", rf"^\\(?=\\*{_HEADER})", "") if literal else F.col("line")
    titled = lines.withColumn("level", F.length(mark)).withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,4}\s+", "")))
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    out = titled.withColumn("part", F.sum((F.col("level") > 0).cast("int")).over(so_far))
    # A header's part of the last header at or above each level: a deeper title counts if no higher header came later.
    for name, level in LEVELS.items():
        out = out.withColumn(f"{name}_at", F.max(F.when(F.col("level") == level, F.col("pos"))).over(so_far)).withColumn(f"{name}_title", F.last(F.when(F.col("level") == level, F.col("title")), True).over(so_far))
    higher = F.lit(-1)
    for name in LEVELS:
        out = out.withColumn(name, F.when(F.col(f"{name}_at") > higher, F.col(f"{name}_title")))
        higher = F.greatest(higher, F.coalesce(F.col(f"{name}_at"), F.lit(-1)))
    body = out.where("level = 0").withColumn("line", line)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")
    got = body.groupBy("doc_id", "part").agg(*[F.first(n, True).alias(n) for n in LEVELS], F.trim(joined).alias("content"))
    return got if literal else got.where("content <> ''")


def clause_pack(c: Column | str, size: int = DEFAULTS.chunk_size) -> Column:
    """Pieces cut before [clause] lines, merged greedily up to ``size`` characters; a longer piece stays whole (C02). Null gives null. Merging
    goes through the pieces once, in Arrow batches: appending within an expression would copy the pieces before each time."""

    def pack(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else merged(t) for t in texts], dtype=object)

    def merged(text: str) -> list[str]:
        first, *rest = text.split("\n[clause]")
        out, held, n = [], [first], len(first)
        for piece in (f"[clause]{p}" for p in rest):
            if n + 1 + len(piece) <= size:
                held.append(piece)
                n += 1 + len(piece)
            else:
                out.append("\n".join(held))
                held, n = [piece], len(piece)
        return [*out, "\n".join(held)]

    return F.pandas_udf(pack, "array<string>")(F.col(c) if isinstance(c, str) else c)


def windows(tokens: Column, size: int, step: int | None = None) -> Column:
    """Token runs of ``size`` every ``step`` (C03, C08); each token is in at least one."""
    step = step or size

    def cut(words: Column) -> Column:
        n = F.size(words)
        last = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("int")
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(words, (i * step + 1).cast("int"), size))).otherwise(F.array().cast("array<array<string>>"))

    return bound(tokens, cut)


def sentence_runs(tokens: DataFrame, n: int) -> DataFrame:
    """tokens (doc_id, pos, token): chunk number of each token, a chunk after every n tokens that end with . ! or ?."""
    before = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("token").rlike(r"[.!?]$").cast("int")
    return tokens.withColumn("chunk", F.floor(F.coalesce(F.sum(ends).over(before), F.lit(0)) / n))


def similarity_chunks(sentences: DataFrame, threshold: float) -> DataFrame:
    """sentences (doc_id, pos, similarity to the one before): a chunk starts where the similarity falls below."""
    so_far = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return sentences.withColumn("chunk", F.sum(F.coalesce((F.col("similarity") < threshold).cast("int"), F.lit(0))).over(so_far))


# Fixed value: a sentence with the marks and blanks that end it; sentences tile a text.
SENTENCE = r"[^.!?\n]*[.!?\n]+[ \t\r\n]*|[^.!?\n]+"


def _sentences(docs: DataFrame) -> DataFrame:
    """doc_id, pos, text of the sentences of docs (doc_id, text)."""
    return docs.select("doc_id", F.posexplode(F.regexp_extract_all("text", F.lit(SENTENCE), F.lit(0))).alias("pos", "text"))


def _spanned(sized: DataFrame) -> DataFrame:
    """Sentences with their lengths n (characters) and m (tokens) get start, end, token_start, token_end instead. No token crosses the end of a sentence, so running
    sums of both lengths give both offsets."""
    upto = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    ends = sized.withColumn("end", F.sum("n").over(upto)).withColumn("token_end", F.sum("m").over(upto))
    return ends.withColumn("start", F.col("end") - F.col("n")).withColumn("token_start", F.col("token_end") - F.col("m")).drop("n", "m")


def sentence_spans(docs: DataFrame) -> DataFrame:
    """doc_id, pos, start, end, token_start, token_end, text of the sentences of docs (doc_id, text): spans in characters and in tokens, ends exclusive."""
    sized = _sentences(docs).withColumn("n", F.length("text").cast("long")).withColumn("m", F.size(tokens("text")).cast("long"))
    return _spanned(sized).select("doc_id", "pos", "start", "end", "token_start", "token_end", "text")


def _neighbour_drops(sentences: DataFrame, rows: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """doc_id, pos, n, m, drop of sentences (doc_id, pos, n, words), which follow each other as their documents were cut: vectors meet the one before within the task, so
    none is shuffled. The state is one vector."""

    def drops(batches):
        last, last_m = np.zeros(0), 0
        for b in batches:
            pos, m = b.column("pos").to_numpy(), pc.list_value_length(b.column("words")).to_numpy()
            v = rows(b.column("words")).astype(float)
            before = np.concatenate([last[None] if len(last) else np.zeros_like(v[:1]), v[:-1]])
            counts_before = np.append(last_m, m[:-1])
            both = np.sqrt((v * v).sum(1)) * np.sqrt((before * before).sum(1))
            drop = 1 - np.where(both > 0, (v * before).sum(1) / np.where(both > 0, both, 1), 0.0)
            there = (pos > 0) & (m > 0) & (counts_before > 0)
            if len(v):
                last, last_m = v[-1], m[-1]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("pos"), b.column("n"), pa.array(m.astype(np.int64)), pa.array(drop, mask=~there)], ["doc_id", "pos", "n", "m", "drop"])

    kinds = sentences.schema
    return sentences.mapInArrow(drops, T.StructType([kinds["doc_id"], kinds["pos"], kinds["n"], T.StructField("m", T.LongType()), T.StructField("drop", T.DoubleType())]))


def semantic_chunks(docs: DataFrame, embed: Callable[[DataFrame], DataFrame] | None = None, quantile: float = 0.95, rows: Callable[[pa.Array], np.ndarray] | None = None) -> DataFrame:
    """doc_id, chunk, start, end, token_start, token_end: sentences in runs that end where the similarity of neighbours drops most, by more than the quantile of a
    document's drops (C06). A sentence without a vector is like its neighbours. The spans tile the text.

    embed turns (id, text) into (id, embedding), which meets its sentence again by a join. rows turns lists of tokens into rows of vectors within a task; a list without
    tokens has no vector."""
    by = Window.partitionBy("doc_id").orderBy("pos")
    if rows:
        cut = _sentences(docs).select("doc_id", "pos", F.length("text").cast("long").alias("n"), tokens("text").alias("words"))
        drops = _spanned(_neighbour_drops(cut, rows).withColumn("drop", F.round("drop", 6)))
    else:
        sentences = kept(sentence_spans(docs))
        ids = F.concat_ws(":", "doc_id", "pos")
        vectors = embed(sentences.select(ids.alias("id"), "text"))
        met = sentences.drop("text").withColumn("id", ids).join(vectors, "id", "left").withColumn("before", F.lag("embedding").over(by))
        drops = met.withColumn("drop", F.when(F.col("before").isNotNull() & F.col("embedding").isNotNull(), F.round(1 - cosine("embedding", "before"), 6))).drop("before", "embedding")
    limited = drops.withColumn("limit", F.round(F.percentile("drop", F.lit(quantile)).over(Window.partitionBy("doc_id")), 6))
    cut = limited.withColumn("breaks", F.coalesce((F.col("drop") > F.col("limit")).cast("int"), F.lit(0)))
    numbered = cut.withColumn("chunk", F.sum("breaks").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "chunk").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.min("token_start").alias("token_start"), F.max("token_end").alias("token_end"))


def pack_batches(rows: DataFrame, group: str, order: str, length: str, budget: int, reserve: int = 100) -> DataFrame:
    """rows with batch: in order, a new batch starts where the sum of lengths would pass budget - reserve (W06). A row's batch
    depends on all before it, so a group's rows pass through one task, which holds a running sum only."""
    columns = rows.columns

    def pack(batches):
        last, total, number = None, 0, 0
        for b in batches:
            out = []
            for g, n in zip(b.column(columns.index(group)).to_pylist(), b.column(columns.index(length)).to_pylist(), strict=True):
                if g != last:
                    last, total, number = g, 0, 0
                n = n or 0
                if total > 0 and total + n > budget - reserve:
                    total, number = 0, number + 1
                total += n
                out.append(number)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.int32())], [*b.schema.names, "batch"])

    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(pack, T.StructType([*rows.schema.fields, T.StructField("batch", T.IntegerType())]))


def shift_spans(spans: DataFrame, n_instruction: int = 0, prefix: bool = True, sep: bool = True) -> DataFrame:
    """spans (doc_id, i, start, end; end exclusive) moved for the tokens a model puts around a text (C09): all ends by the leading token and
    the instruction, all starts but the first one's, which takes these tokens in (without ``prefix`` it moves too); the
    last end takes in the closing token if ``sep``."""
    lead = 1 + n_instruction
    by = Window.partitionBy("doc_id")
    moved = spans.withColumn("_first", F.min("i").over(by) == F.col("i")).withColumn("_last", F.max("i").over(by) == F.col("i"))
    start = F.when(F.col("_first") & F.lit(prefix), F.col("start")).otherwise(F.col("start") + lead)
    end = F.col("end") + lead + F.when(F.col("_last") & F.lit(sep), 1).otherwise(0)
    return moved.withColumns({"start": start, "end": end}).drop("_first", "_last")


def truncated(text: Column | str, title: Column | str, most: int) -> Column:
    """The text up to the end of the last token that fits with the title's tokens (C10); without room or tokens it is empty."""
    from lexiflume.functions.text import WORD, tokens

    c = F.col(text) if isinstance(text, str) else text
    room = F.greatest(F.lit(0), F.lit(most) - F.size(tokens(title)))
    kept = F.slice(F.regexp_extract_all(c, F.lit(f"[^\\p{{L}}\\p{{N}}_]*{WORD}+"), F.lit(0)), 1, room)
    return F.array_join(F.coalesce(kept, F.array().cast("array<string>")), "")


CHUNKERS = {"markdown": header_split, "sentences": sentence_runs, "semantic": similarity_chunks}


def chunker(name: str):
    """The chunker of a name; ValueError on an unknown one."""
    if name not in CHUNKERS:
        raise ValueError(f"unknown chunking strategy: {name}")
    return CHUNKERS[name]
