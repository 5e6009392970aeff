"""N-gram Jaccard join: grouped prefix join over sets of word shingles.

Documents with the same set are one node. Nodes with the same prefix and size form one group; group pairs that share
a prefix shingle are filtered by size and position, expanded to members, filtered by a parity bitmap and verified
on whole sets. Shingles are ordered by how often the whole corpus has them (rare first), from a table of hashed
counts of fixed size; the order affects work only, never results.

No bucket emits all its pairs. First each member meets the bucket's pivot only; what hangs together after that
needs no further check, and the rest of a bucket (members outside the pivot's component) meets the bucket in blocks of near sizes.
Links join members of one component only, so with ``links`` each component's members are verified against each other in
blocks: a set is kept as its difference from the component's first set, and one matrix product over a block's differences
gives all intersections. n_links counts the other rows that a row links with: those of linked sets and the other rows of its own.

Rules for odd rows: null and empty texts have no shingles, link with nothing and are their own component; repeated
rows give repeated result rows; a null doc_id gives a null component_id unless a linked row has an id; columns other
than id and text are ignored, whatever their names; an empty table gives no rows. Texts of any length are taken whole, one at a time.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from lexiflume.llm.components import components
from lexiflume.llm.scratch import Scratch
from lexiflume.llm.words import row_shingles

#: Cells of the table of hashed counts, and of each piece in which it travels.
CELLS, PIECE = 1 << 21, 1 << 17
#: Tables that one task adds up, on each of two levels.
FAN = 512
#: Bits of the parity bitmap that all sets have; larger sets have a wider one besides, as many bits as shingles at least.
BITS = 1024
#: Candidate ids that may be broadcast (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Members of a bucket's block.
BLOCK = 4096
#: Members of a block whose links are counted, and shingles in which they differ from their component's first set, about.
LINKED, DIFFERING = 1024, 1 << 20


def _sets(batches: Iterator[pa.RecordBatch], k: int):
    for batch in batches:
        yield batch, list(row_shingles(batch.column("text"), k))


def _cell(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(43)).astype(np.int64)


def shingle_levels(docs: DataFrame, k: int) -> np.ndarray:
    """A level for each cell of the table of hashed counts over all documents: 0 for counts that chance explains."""

    def count(batches):
        cells = np.zeros(CELLS, np.int64)
        for _, sets in _sets(batches, k):
            if sets:
                cells += np.bincount(_cell(np.concatenate(sets)), minlength=CELLS)
        if cells.any():
            pieces = [zlib.compress(cells[i : i + PIECE].astype(np.int32).tobytes(), 1) for i in range(0, CELLS, PIECE)]
            yield pa.RecordBatch.from_pydict({"piece": list(range(len(pieces))), "meet": [TaskContext.get().partitionId() // FAN] * len(pieces), "counts": pieces})

    def add(batches):
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for piece, meet, counts in zip(*(batch.column(c).to_pylist() for c in ("piece", "meet", "counts")), strict=True):
                sums[piece, meet] = sums.get((piece, meet), 0) + np.frombuffer(zlib.decompress(counts), np.int32).astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_pydict({"piece": [p for p, _ in sums], "meet": [m for _, m in sums], "counts": [zlib.compress(np.minimum(x, 2**31 - 1).astype(np.int32).tobytes(), 1) for x in sums.values()]})

    schema = "piece long, meet long, counts binary"
    counts = docs.mapInArrow(count, schema).repartition("piece", "meet").mapInArrow(add, schema)
    counts = counts.withColumn("meet", F.lit(0).cast("long")).repartition("piece").mapInArrow(add, schema)
    total = np.zeros(CELLS, np.int64)
    for row in counts.collect():  # 8 MB at most
        total[row.piece * PIECE : (row.piece + 1) * PIECE] += np.frombuffer(zlib.decompress(row.counts), np.int32)
    mean = total.sum() / CELLS
    over = total - (mean + 6 * np.sqrt(mean) + 16)
    return np.where(over > 0, 1 + np.log2(np.maximum(over, 1)), 0).astype(np.uint8)


def _bitmaps(s: np.ndarray) -> tuple[bytes, bytes | None]:
    """The parity of the shingles in each cell: with BITS cells, and for larger sets with more. Two sets differ in at least as
    many shingles as their bitmaps in bits."""
    width = BITS
    while width < len(s):
        width *= 2
    odd = (np.bincount((s & np.uint64(width - 1)).astype(np.int64), minlength=width) & 1).astype(np.uint8)
    wide = np.packbits(odd)
    return np.bitwise_xor.reduce(wide.reshape(-1, BITS // 8)).tobytes(), wide.tobytes() if width > BITS else None


def _apart(a: bytes, b: bytes) -> int:
    """Bits in which two bitmaps differ; the wider one is folded to the other's width, which keeps parities."""
    x, y = np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)
    width = min(len(x), len(y))
    x, y = (np.bitwise_xor.reduce(z.reshape(-1, width)) for z in (x, y))
    return int(np.bitwise_count(x ^ y).sum())


def signatures(docs: DataFrame, k: int, percent: int, levels: np.ndarray) -> DataFrame:
    """One row per document: n, node (hash of its set), grp (hash of size and prefix), rare, prefix, bits."""
    sent = docs.sparkSession.sparkContext.broadcast(levels)

    def sign(batches):
        level = sent.value
        for batch, sets in _sets(batches, k):
            out = {x: [] for x in ("n", "node", "grp", "rare", "prefix", "bits", "wide")}
            for s in sets:
                n, lev = len(s), level[_cell(s)]
                prefix = s[np.argsort(lev, kind="stable")[: n - (percent * n + 99) // 100 + 1]] if n else s
                out["n"].append(n)
                out["node"].append(xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 if n else None)
                out["grp"].append(xxhash.xxh3_64_intdigest(prefix.tobytes(), n) - 2**63 if n else None)
                out["rare"].append(int((lev == 0).sum()))
                out["prefix"].append(prefix.view(np.int64))
                for name, bitmap in zip(("bits", "wide"), _bitmaps(s), strict=True):
                    out[name].append(bitmap)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_hash"), *(pa.array(out[x], t) for x, t in (("n", pa.int64()), ("node", pa.int64()), ("grp", pa.int64()), ("rare", pa.int64()), ("prefix", pa.list_(pa.int64())), ("bits", pa.binary()), ("wide", pa.binary())))],
                ["doc_id", "text_hash", *out],
            )

    return docs.mapInArrow(sign, "doc_id long, text_hash long, n long, node long, grp long, rare long, prefix array<long>, bits binary, wide binary")


def _need(both: np.ndarray, percent: int) -> np.ndarray:
    """The least intersection that links two sets with so many shingles together."""
    return -(-percent * both // (100 + percent))


def _partnered(batches, percent: int):
    """Rows (tok, gid, np: size and position) come sorted by tok and size. Passes on those that another row of the same
    tok can match: sizes within the threshold, and the smaller of the two placed early enough for the needed intersection."""

    def kept(tok, gid, np_):
        n, pos = np_ >> 32, np_ & 0xFFFFFFFF
        at = np.arange(len(tok))
        run = np.concatenate([[0], np.cumsum(tok[1:] != tok[:-1])])
        early = n - pos >= _need(2 * n, percent)  # can be the smaller one, or as large
        # The nearest early row before, of the same tok: the largest that can be the smaller partner.
        before = np.maximum.accumulate(np.where(early, at, -1))
        before = np.concatenate([[-1], before[:-1]])
        has = (before >= 0) & (run[before] == run) & (100 * n[before] >= percent * n)
        after = np.concatenate([(run[1:] == run[:-1]) & (100 * n[:-1] >= percent * n[1:]), [False]])
        keep = has | (early & after)
        if hot is not None:
            keep |= tok == hot
        return pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (tok, gid, np_)], ["tok", "gid", "np"])

    held, hot = None, None
    for batch in batches:
        rows = np.stack([batch.column(c).to_numpy() for c in ("tok", "gid", "np")])
        rows = rows if held is None else np.concatenate([held, rows], axis=1)
        if not rows.shape[1]:
            continue
        cut = int(np.searchsorted(rows[0], rows[0][-1]))  # the last run may go on
        if cut:
            yield kept(*rows[:, :cut])
        held = rows[:, cut:]
        if held.shape[1] > 500_000:  # a hot one goes on whole
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in held[:, :-1]], ["tok", "gid", "np"])
            held, hot = held[:, -1:], held[0, -1]
    if held is not None and held.shape[1]:
        yield kept(*held)


def _needed(a: str, b: str, percent: int) -> str:
    """The least intersection of two sets of these sizes that links them."""
    return f"(({percent} * ({a} + {b}) + {99 + percent}) div {100 + percent})"


def _filter(percent: int) -> str:
    """Size, and position as the first common shingle; a pair that links passes in the bucket of its first common one."""
    return f"""100 * least(l.n, r.n) >= {percent} * greatest(l.n, r.n)
        and least(l.n - l.pos, r.n - r.pos) >= {_needed("l.n", "r.n", percent)}"""


def _close(l: np.ndarray, r: np.ndarray, n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False where parity bitmaps (rows of bytes) prove that two sets differ in too many shingles."""
    apart = np.bitwise_count(l.view(np.uint64) ^ r.view(np.uint64)).sum(-1)
    both = n + m
    return apart <= both - 2 * _need(both, percent)


def _bits(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, BITS // 8)


def _whole_sets(wanted: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, scratch: Scratch, tag: str) -> DataFrame:
    """node, shingles (8 bytes each, sorted) of the wanted nodes, made again from one text each; rows can repeat."""

    def resets(batches):
        for _, sets in _sets(batches, k):
            yield pa.RecordBatch.from_arrays([pa.array([xxhash.xxh3_64_intdigest(s.tobytes()) - 2**63 for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["node", "shingles"])

    ids = scratch.keep(f"{tag}-ids", wanted.join(nodes.select("node", "home", "home_hash"), "node").select("home", "home_hash"))
    near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    texts = docs.join(near, docs.doc_id.eqNullSafe(ids.home) & (docs.text_hash == ids.home_hash), "left_semi")
    return texts.mapInArrow(resets, "node long, shingles binary")


def _verified(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch, tag: str) -> DataFrame:
    """Of pairs (u, v) of nodes, those whose whole sets reach the threshold."""

    def near(batches):
        for b in batches:
            ln, rn = b.column("ln").to_numpy(), b.column("rn").to_numpy()
            keep = _close(_bits(b.column("lb")), _bits(b.column("rb")), ln, rn, percent)
            left, right = b.column("lw").to_pylist(), b.column("rw").to_pylist()
            for i in np.flatnonzero(keep).tolist():
                if left[i] and right[i]:
                    both = int(ln[i] + rn[i])
                    keep[i] = _apart(left[i], right[i]) <= both - 2 * -(-percent * both // (100 + percent))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep)), b.column("v").filter(pa.array(keep))], ["u", "v"])

    def verify(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("ls").to_pylist(), b.column("rs").to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("u").filter(pa.array(keep, pa.bool_())), b.column("v").filter(pa.array(keep, pa.bool_()))], ["u", "v"])

    small = nodes.select("node", "n", "bits", "wide")
    wide = pairs.join(small.toDF("u", "ln", "lb", "lw"), "u").join(small.toDF("v", "rn", "rb", "rw"), "v")
    left = scratch.keep(f"{tag}-near", wide.select("u", "v", "ln", "rn", "lb", "rb", "lw", "rw").mapInArrow(near, "u long, v long"))
    # Dealt out by node once: both joins below stand on the same exchange.
    sets = _whole_sets(left.select(F.explode(F.array("u", "v")).alias("node")).distinct(), nodes, docs, k, scratch, tag).dropDuplicates(["node"])
    whole = left.join(sets.toDF("v", "rs"), "v").join(sets.toDF("u", "ls"), "u").select("u", "v", "ls", "rs")
    links = scratch.keep(f"{tag}-links", whole.mapInArrow(verify, "u long, v long"))
    scratch.drop(f"{tag}-near", f"{tag}-ids")
    return links


def _size_class(n: str, percent: int) -> Column:
    """Sets that link lie in the same class or in adjacent ones."""
    return F.floor(F.log(F.col(n)) / max(1.001 * math.log(100 / percent), 1e-3)).cast("int")


def _cells(rows: DataFrame, group: str, load: Column, cap: int, most: int) -> DataFrame:
    """Deals the members of groups into cells (group, c, kind, i, j) so that any two that can match meet in one, but for two that
    both are ``top``. rows: group, node, n_class, top. A cell holds two blocks of about ``cap`` members, with ``load`` about
    ``most`` in sum. Within a cell every member meets the others (kind 0, i = j), or side 0 meets side 1."""
    per = rows.groupBy(group, "n_class").agg(F.count(F.when(~F.col("top"), 1)).alias("outs"), F.count(F.when(F.col("top"), 1)).alias("ins"), F.sum(load).alias("load"))
    room = F.least(F.lit(float(cap)), F.greatest(F.lit(1.0), F.lit(float(most)) * (F.col("outs") + F.col("ins")) / F.greatest(F.col("load"), F.lit(1))))
    per = per.withColumns({"no": F.ceil(F.col("outs") / room).cast("int"), "ni": F.ceil(F.col("ins") / room).cast("int")})
    # A map has one entry for each size class: some dozens.
    sizes = per.groupBy(group).agg(
        F.map_from_entries(F.collect_list(F.struct("n_class", F.struct("no", "ni")))).alias("m"),
        ((F.sum(F.col("outs") + F.col("ins")) <= cap) & (F.sum("load") <= most)).alias("small"), F.sum("outs").alias("outs"),
    ).where("outs > 0").drop("outs")
    at = rows.join(sizes, group)
    one = at.where("small").select("*", F.expr("struct(0 as c, 0 as kind, 0 as i, 0 as j, 0 as side) as cell"))
    run = lambda kind, c: f"if(coalesce(try_element_at(m, {c}).{kind}, 0) > 0, sequence(0, try_element_at(m, {c}).{kind} - 1), cast(array() as array<int>))"
    cell = lambda c, kind, i, j, side: f"struct({c} as c, {kind} as kind, {i} as i, {j} as j, {side} as side)"
    many = at.where("not small").withColumn("b", F.expr("cast(pmod(xxhash64(node), if(top, m[n_class].ni, m[n_class].no)) as int)"))
    outer = [
        f"transform({run('no', 'n_class')}, x -> {cell('n_class', 0, 'least(x, b)', 'greatest(x, b)', 'if(b <= x, 0, 1)')})",
        f"transform({run('no', 'n_class + 1')}, x -> {cell('n_class', 1, 'b', 'x', 0)})",
        f"transform({run('no', 'n_class - 1')}, x -> {cell('n_class - 1', 1, 'x', 'b', 1)})",
        *(f"transform({run('ni', f'n_class + {d}')}, x -> {cell('n_class', 3 + d, 'b', 'x', 0)})" for d in (-1, 0, 1)),
    ]
    inner = [f"transform({run('no', f'n_class - {d}')}, x -> {cell(f'n_class - {d}', 3 + d, 'x', 'b', 1)})" for d in (-1, 0, 1)]
    spread = many.withColumn("cell", F.explode(F.expr(f"if(top, concat({', '.join(inner)}), concat({', '.join(outer)}))"))).drop("b")
    out = one.unionByName(spread).select(*rows.columns, "cell.*")
    key = [group, "c", "kind", "i", "j"]
    return out.repartition(*key).sortWithinPartitions(*key, "side", "node")


def _by_cell(batches, group: str, at_once: int) -> Iterator[pa.Table]:
    """Tables of whole cells, of at_once rows or one cell at least."""
    held: list[pa.RecordBatch] = []

    def cut(done: bool) -> Iterator[pa.Table]:
        t = pa.Table.from_batches(held).combine_chunks()
        key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in (group, "c", "kind", "i", "j")])
        until = t.num_rows if done else int(np.flatnonzero(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)]))[-1])
        held[:] = t.slice(until).to_batches()
        if until:
            yield t.slice(0, until)

    rows = 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= at_once:
            yield from cut(False)
            rows = 0
    if held:
        yield from cut(True)


def _run_ends(keys: np.ndarray) -> np.ndarray:
    """For each of the sorted columns the end of the run of columns equal to it."""
    run = np.concatenate([[0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))])
    return np.searchsorted(run, run, "right")


def _partners(t: pa.Table, group: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of whole cells the run [start, end) of rows that it meets, and whether its cell is one block."""
    key = np.stack([t.column(c).to_numpy().astype(np.int64) for c in (group, "c", "kind", "i", "j", "side")])
    cell_end, side_end = _run_ends(key[:5]), _run_ends(key)
    same = (key[2] == 0) & (key[3] == key[4])
    return np.where(same, np.arange(t.num_rows) + 1, np.where(key[5] == 0, side_end, cell_end)), cell_end, same


def _rest(entries: DataFrame, bitmaps: DataFrame, percent: int) -> DataFrame:
    """entries (tok, node, n, pos, comp, top: comp is the pivot's), bitmaps (node, bits). Candidate pairs across components, at least
    one of the two outside the pivot's component; buckets go block against block."""
    rows = entries.withColumn("n_class", _size_class("n", percent)).join(bitmaps, "node")
    parts = _cells(rows, "tok", F.lit(1), BLOCK, BLOCK)

    def meet(batches):
        for t in _by_cell(batches, "tok", 20_000):
            n, pos, comp, node = (t.column(c).to_numpy() for c in ("n", "pos", "comp", "node"))
            bits = _bits(t.column("bits").combine_chunks()).view(np.uint64)
            start, end, _ = _partners(t, "tok")
            # Pairs (x, start + d) for all rows at once; rows whose run ends before that drop out.
            x, d = np.arange(t.num_rows), -1
            while True:
                d += 1
                x = x[start[x] + d < end[x]]
                if not len(x):
                    break
                u, v = x, start[x] + d
                both = n[u] + n[v]
                ok = (comp[u] != comp[v]) & (100 * np.minimum(n[u], n[v]) >= percent * np.maximum(n[u], n[v])) & (np.minimum(n[u] - pos[u], n[v] - pos[v]) >= _need(both, percent))
                u, v, both = u[ok], v[ok], both[ok]
                near = np.bitwise_count(bits[u] ^ bits[v]).sum(-1) <= both - 2 * _need(both, percent)
                if near.any():
                    u, v = node[u[near]], node[v[near]]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], ["u", "v"])

    return parts.mapInArrow(meet, "u long, v long").distinct()


def _differing(own: np.ndarray, first: np.ndarray) -> np.ndarray:
    both, times = np.unique(np.concatenate([own, first]), return_counts=True)
    return both[times == 1]


def _shared(cols: np.ndarray, rows: np.ndarray, left: int, n_rows: int) -> np.ndarray:
    """How many columns each of the first ``left`` rows shares with each row; entries (column, row) come in any order."""
    _, back, times = np.unique(cols, return_inverse=True, return_counts=True)
    several = times[back] > 1
    cols, rows = back[several], rows[several]
    order = np.argsort(cols, kind="stable")
    cols, rows = cols[order], rows[order]
    new = np.concatenate([[0], np.cumsum(cols[1:] != cols[:-1])]) if len(cols) else cols
    out, step = np.zeros((left, n_rows), np.float32), 2048
    for a in range(0, int(new[-1]) + 1 if len(new) else 0, step):
        lo, hi = np.searchsorted(new, [a, a + step])
        m = np.zeros((n_rows, step), np.float32)
        m[rows[lo:hi], new[lo:hi] - a] = 1
        out += m[:left] @ m.T
    return out


def _link_counts(comps: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, percent: int, scratch: Scratch) -> DataFrame:
    """comps (node, component). Returns node, others: rows of other sets that link with the node's."""
    members = scratch.keep("members", comps.join(nodes.select("node", "n", "copies"), "node"))
    sized = members.groupBy("component").agg(F.count("*").alias("size"), F.sum("copies").alias("all"))
    # Two nodes make a component by their link alone.
    pairs = members.join(sized.where("size = 2"), "component").select("node", (F.col("all") - F.col("copies")).alias("others"))
    more = members.join(sized.where("size > 2").select("component"), "component")
    sets = scratch.keep("member-sets", _whole_sets(more.select("node"), nodes, docs, k, scratch, "member").dropDuplicates(["node"]))

    def differ(batches):
        for b in batches:
            cut = [_differing(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)) for x, y in zip(b.column("shingles").to_pylist(), b.column("first").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("component", "node", "n", "copies")), pa.array([len(x) for x in cut], pa.int64()), pa.array([x.tobytes() for x in cut], pa.binary())], ["component", "node", "n", "copies", "d", "differing"])

    # A component is named by its least node, whose set is the one that the others' are told by.
    whole = more.join(sets, "node").join(sets.toDF("component", "first"), "component").select("component", "node", "n", "copies", "shingles", "first")
    told = scratch.keep("told", whole.mapInArrow(differ, "component long, node long, n long, copies long, d long, differing binary"))
    scratch.drop("member-sets", "member-ids")
    rows = told.withColumns({"n_class": _size_class("n", percent), "top": F.lit(False)})
    parts = _cells(rows, "component", F.col("d"), LINKED, DIFFERING)

    def count(batches):
        for t in _by_cell(batches, "component", 1):
            start, end, same = _partners(t, "component")
            n, d, copies, node = (t.column(c).to_numpy() for c in ("n", "d", "copies", "node"))
            bounds = [0, *np.unique(end).tolist()]
            for a, z in zip(bounds, bounds[1:], strict=False):
                left = z - a if same[a] else int(start[a]) - a
                if z - a == 1 or left == z - a and not same[a]:  # nobody to meet
                    continue
                cols = np.frombuffer(b"".join(t.column("differing").slice(a, z - a).to_pylist()), np.uint64)
                shared = _shared(cols, np.repeat(np.arange(z - a), d[a:z]), left, z - a)
                twice = (n[a:z] - d[a:z])[:left, None] + (n[a:z] - d[a:z])[None] + 2 * shared  # of the intersection
                linked = (100 + percent) * twice >= 2 * percent * (n[a:z][:left, None] + n[a:z][None])
                if same[a]:
                    np.fill_diagonal(linked, False)
                    others = linked @ copies[a:z]
                else:
                    linked = linked[:, left:]
                    others = np.concatenate([linked @ copies[a + left : z], linked.T @ copies[a : a + left]])
                yield pa.RecordBatch.from_arrays([pa.array(node[a:z]), pa.array(others.astype(np.int64))], ["node", "others"])

    counted = parts.select("component", "c", "kind", "i", "j", "side", "node", "n", "copies", "d", "differing").mapInArrow(count, "node long, others long")
    found = scratch.keep("degrees", counted.groupBy("node").agg(F.sum("others").alias("others")).union(pairs))
    scratch.drop("members", "told")
    return found


def jaccard_components(documents: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", links: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """Returns doc_id, text_hash (xxhash64 of the text), n_shingles, node (null without shingles) and component_id
    for each row: the least doc_id reachable by links of at least ``percent`` / 100 Jaccard similarity over
    ``k``-word shingles; comp_node names the component itself. With ``links`` all links are counted, and
    n_links is the number of other rows that link with a row; without, only those that components need are verified."""
    scratch = scratch or Scratch(documents.sparkSession)
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    levels = shingle_levels(docs.select("text"), k)
    base = scratch.keep("base", signatures(docs, k, percent, levels))

    # Nodes: one per set. home is the row from which its set can be made again.
    some = base.where("n > 0")
    nodes = some.groupBy("node").agg(F.min("doc_id").alias("home"), F.min_by("text_hash", "doc_id").alias("home_hash"), F.first("text_hash").alias("any_hash"), F.count("*").alias("copies"), F.first("n").alias("n"), F.first("grp").alias("grp"), F.first("rare").alias("rare"), F.first("bits").alias("bits"), F.first("wide").alias("wide"), F.first("prefix").alias("prefix"))
    nodes = scratch.keep("nodes", nodes.withColumn("home_hash", F.coalesce("home_hash", "any_hash")).drop("any_hash"))
    # Groups: same prefix and size; the leader is the member with the fewest rare shingles.
    groups = nodes.groupBy("grp").agg(F.min(F.struct("rare", "node")).alias("lead"), F.count("*").alias("members")).select("grp", F.col("lead.node").alias("gid"), "members")
    big = scratch.keep("big", groups.where("members > 1").select("grp", "gid"))
    others = scratch.keep("others", nodes.select("node", "grp").join(big, "grp").where("node <> gid").select("node"))
    leaders = nodes.join(F.broadcast(others) if others.count() <= BROADCAST_IDS else others, "node", "left_anti")
    tokens = leaders.select("node", "n", F.posexplode("prefix").alias("pos", "tok")).select("tok", F.col("node").alias("gid"), F.expr("shiftleft(n, 32) | pos").alias("np"))
    shared = tokens.repartition("tok").sortWithinPartitions("tok", "np").mapInArrow(lambda it: _partnered(it, percent), "tok long, gid long, np long")
    lead = nodes.select(F.col("node").alias("gid"), "rare", "grp")
    entries = scratch.keep("entries", shared.select("tok", "gid", F.expr("shiftright(np, 32)").alias("n"), F.expr("np & 4294967295L").alias("pos")).join(lead, "gid"))

    # Each group meets its bucket's pivot, each member its group's leader.
    pivots = entries.groupBy("tok").agg(F.min(F.struct("rare", "gid", "n", "pos")).alias("p")).select("tok", "p.*")
    l, r = entries.alias("l"), pivots.alias("r")
    stars = l.join(r, "tok").where("l.gid <> r.gid").where(_filter(percent)).select(F.col("r.gid").alias("gid"), F.col("l.grp").alias("grp")).distinct()
    # Expanded: the pivot (leader of its group) against every member of the other group.
    member = nodes.select("grp", "node")
    opened = stars.join(member, "grp").select(F.col("gid").alias("u"), F.col("node").alias("v"))
    inside = nodes.join(big.toDF("grp", "u"), "grp").where("node <> u").select("u", F.col("node").alias("v"))
    pairs = opened.union(inside).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    first = _verified(pairs, nodes, docs, k, percent, scratch, "star")
    comps = scratch.keep("comps", components(first, scratch, "star-cc"))

    # What still lies in another component than its bucket's pivot meets the bucket.
    as_bucket = nodes.join(big, "grp").select(F.col("grp").alias("tok"), "node", "n", F.lit(0).cast("long").alias("pos"), F.col("gid").alias("pivot"))
    by_token = entries.join(member, "grp").join(pivots.select("tok", F.col("gid").alias("pivot")), "tok").select("tok", "node", "n", "pos", "pivot")
    named = comps.select("node", "component")
    at = by_token.union(as_bucket).join(named, "node", "left").withColumn("comp", F.coalesce("component", "node")).drop("component")
    at = at.join(named.toDF("pivot", "pc"), "pivot", "left").withColumn("top", F.col("comp") == F.coalesce("pc", "pivot"))
    # A member outside can link only within the size ratio; buckets all inside the pivot's component are done.
    mixed = at.groupBy("tok").agg(F.min("top").alias("pure")).where("not pure").select("tok")
    rest = scratch.keep("rest", at.join(mixed, "tok", "left_semi").select("tok", "node", "n", "pos", "comp", "top"))
    scratch.drop("entries")
    pairs = scratch.keep("rest-pairs", _rest(rest, nodes.select("node", "bits"), percent))
    more = _verified(pairs, nodes, docs, k, percent, scratch, "rest")
    scratch.drop("rest", "rest-pairs", "big", "others")
    final = scratch.keep("final", components(first.union(more), scratch, "cc"))
    scratch.drop("comps", "star-links", "rest-links")
    degrees = _link_counts(final, nodes, docs, k, percent, scratch) if links else None

    least = nodes.join(final, "node", "left").withColumn("comp_node", F.coalesce("component", "node"))
    least = least.join(degrees, "node", "left").withColumn("n_links", F.col("copies") - 1 + F.coalesce("others", F.lit(0))) if links else least.withColumn("n_links", F.lit(None).cast("long"))
    ids = least.groupBy("comp_node").agg(F.min("home").alias("component_id"))
    named = scratch.keep("named", least.select("node", "comp_node", "n_links").join(ids, "comp_node"))
    scratch.drop("nodes", "final", *(["degrees"] if links else []))
    out = base.select("doc_id", "text_hash", F.col("n").alias("n_shingles"), "node").join(named, "node", "left")
    out = out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"), "text_hash", "node", "comp_node", F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return out if links else out.drop("n_links")
