"""Line dedup: lines that many documents share go from all of them but one.

Lines are exploded with their places and 128-bit hashes of their keys, the documents of each hash are counted, and the
lines of common ones are dropped; each text is put together again from its other lines in their order. Equal lines of a
document count once: pairs of hash and document come first, then sums for each hash, so that a line of every second document is
added up before it is shuffled. Only hashes and places are shuffled for this, texts once, to meet the places of their dropped lines.

A line's key is the line without white space ([\\x20\\x09-\\x0D]) at its ends, A-Z lower-cased. Null and empty texts have one empty line. Rows with
one doc_id are one document; those with a null doc_id are one, which comes before all others. Repeated rows have the same
lines dropped. Of the documents that hold a common key the one with the largest doc_id keeps all its lines with it. Texts may have any length: only a
document's places of dropped lines are gathered. An empty table gives no rows.
Other columns stay; n_lines and n_dropped of the input are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from lexiflume.llm.lookup import lookup
from lexiflume.llm.scratch import Scratch, unused

_BLANK = b" \t\n\x0b\x0c\r"
_HASHES = ["h1", "h2"]


def _keyed_lines(min_chars: int):
    """(doc_id, text_hash, text) to (doc_id, text_hash, pos, h1, h2) of the lines whose keys are long enough."""

    def work(batches):
        for b in batches:
            rows, places, hashes = [], [], []
            for i, text in enumerate(b.column("text")):
                for pos, line in enumerate((text.as_py() or "").encode("utf-8", "surrogatepass").split(b"\n")):
                    key = line.strip(_BLANK).lower()  # bytes.lower knows A-Z only
                    if len(key) >= min_chars and (key.isascii() or len(key.decode("utf-8", "surrogatepass")) >= min_chars):
                        rows.append(i)
                        places.append(pos)
                        hashes.append(xxhash.xxh3_128_digest(key))
            both = np.frombuffer(b"".join(hashes), np.int64).reshape(-1, 2)
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id").take(at), b.column("text_hash").take(at), pa.array(places, pa.int32()), pa.array(both[:, 0]), pa.array(both[:, 1])], ["doc_id", "text_hash", "pos", *_HASHES])

    return work


def _cut(text_at: int, gone_at: int):
    """Texts without the lines at their places; two columns more: lines before, lines dropped."""

    def work(batches):
        for b in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, gone in zip(b.column(text_at), b.column(gone_at), strict=True):
                lines = (text.as_py() or "").split("\n")
                drop = set(gone.as_py() or ())
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else "\n".join(lines))
                n_lines.append(len(lines))
                n_dropped.append(len(drop))
            kept = [c for i, c in enumerate(b.columns) if i not in (text_at, gone_at)]
            names = [n for i, n in enumerate(b.schema.names) if i not in (text_at, gone_at)]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())], [*names, b.schema.names[text_at], "n_lines", "n_dropped"])

    return work


def common_lines(lines: DataFrame, min_docs: int = 3) -> DataFrame:
    """h1, h2, keeper and n (lines) of the keys that at least min_docs documents hold."""
    pairs = lines.groupBy(*_HASHES, "doc_id").agg(F.count("*").alias("n"))
    held = pairs.groupBy(*_HASHES).agg(F.count("*").alias("n_docs"), F.max(F.struct("doc_id")).alias("largest"), F.sum("n").alias("n"))  # a null id is the least
    return held.where(F.col("n_docs") >= min_docs).select(*_HASHES, F.col("largest.doc_id").alias("keeper"), "n")


def dedup_lines(documents: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text", scratch: Scratch | None = None) -> DataFrame:
    """The documents with their texts cut, n_lines (before) and n_dropped. Keys of at least min_chars code points that at least min_docs documents
    hold are common."""
    scratch = scratch or Scratch(documents.sparkSession)
    documents = documents.drop(*[c for c in documents.columns if c.lower() in ("n_lines", "n_dropped")])
    text_hash = F.xxhash64(text_col)  # tells rows with one doc_id apart
    texts = documents.select(F.col(id_col).cast("long").alias("doc_id"), text_hash.alias("text_hash"), F.col(text_col).alias("text"))
    lines = scratch.keep("lines", texts.mapInArrow(_keyed_lines(min_chars), "doc_id long, text_hash long, pos int, h1 long, h2 long"))
    common = scratch.keep("common", common_lines(lines, min_docs))
    dropped = lookup(lines, common, _HASHES, "n", lines.count()).where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    id_, hash_, gone = (unused(n, documents.columns) for n in ("line_doc", "line_text", "line_gone"))
    places = dropped.groupBy(F.col("doc_id").alias(id_), F.col("text_hash").alias(hash_)).agg(F.collect_set("pos").alias(gone))
    places = scratch.keep("places", places)
    met = documents.join(places, F.col(id_col).cast("long").eqNullSafe(F.col(id_)) & (text_hash == F.col(hash_)), "left").drop(id_, hash_)
    kinds = {f.name: f.dataType.simpleString() for f in documents.schema.fields}
    others = [c for c in documents.columns if c != text_col]
    schema = ", ".join([*[f"`{c}` {kinds[c]}" for c in others], f"`{text_col}` string", "n_lines long", "n_dropped long"])
    return met.mapInArrow(_cut(met.columns.index(text_col), met.columns.index(gone)), schema).select(*[f"`{c}`" for c in documents.columns], "n_lines", "n_dropped")


#: DuckDB SQL for doc_id, n_lines, n_dropped and the SHA-256 of the text, with the default parameters.
SQL = r"""
with split as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as pos, row_number() over () as row from split),
k as (select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
common as (select key, max(doc_id) as keeper from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, c.key is not null and k.doc_id <> c.keeper as gone from k left join common c using (key))
select doc_id, count(*) as n_lines, count(*) filter (gone) as n_dropped, sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not gone), '')) as kept_sha256
from m group by doc_id
"""
