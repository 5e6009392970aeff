"""Golden records: one record for each cluster of clients, each field from the record that its own order puts first.

Windows over a cluster rank its records once for each field; conditional aggregation collapses the winners. A winner over a
cluster is a winner over each part of it that holds it, so this happens twice: within cells of a cluster, dealt at random, then over the
cells' winners. There are as many cells as the square root of the number of all rows, so that a cluster that holds a third of
them is ranked in pieces and no window has more rows than that. Staleness needs the cluster's latest date first, the balance the chosen segment: both
reach the records by their cells.

Sources other than the listed ones, and null, have the least trust. Strings that are empty or hold only [\\x20\\x09-\\x0D] count as null. A balance
that is no finite number, or has more cents than a long holds, counts as null. Null client_ids come last; records
with neither id form one cluster. Repeated rows count as records; among records alike in a field's order the least value
goes first, so the result doesn't depend on the order of rows. An empty table gives no rows; names of any length are taken whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from lexiflume.llm.scratch import Scratch

#: By falling trust.
TRUST = ("partner", "store", "web", "crm")
_BLANK = " \t\n\x0b\x0c\r"


def _recent(w: Column) -> list[Column]:
    return [w["updated_at"].desc_nulls_last(), w["trust"].desc(), w["client_id"].asc_nulls_last()]


def _trusted(w: Column) -> list[Column]:
    return [w["stale"].asc(), w["trust"].desc(), *_recent(w)]


def _null_last(w: Column, by: list[Column]) -> list[Column]:
    return [w["value"].isNull().asc(), *by, w["value"].asc()]


#: The order of each field's candidates (structs with what the order needs); the first wins.
ORDERS: dict[str, Callable[[Column], list[Column]]] = {
    "segment": lambda w: _null_last(w, _recent(w)),
    "email": lambda w: _null_last(w, _trusted(w)),
    "name": lambda w: _null_last(w, [F.length(w["value"]).desc(), *_trusted(w)]),
    "address": lambda w: [w["filled"].desc(), *_trusted(w), w["value"].asc_nulls_last(), w["nation_id"].asc_nulls_last()],
    "balance": lambda w: _null_last(w, [w["other"].asc(), *_recent(w)]),
}


def _collapse(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """One row for each value of the keys: its sums, and of each candidate column the winner."""
    fields = [c for c in df.columns if c in ORDERS]
    ranked = df.select("*", *[F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDERS[f](F.col(f)))).alias(f"{f}_rank") for f in fields])
    return ranked.groupBy(*keys).agg(*[F.sum(s).alias(s) for s in sums], *[F.max(F.when(F.col(f"{f}_rank") == 1, F.col(f))).alias(f) for f in fields])


def _told(rows: DataFrame, cells: DataFrame, name: str) -> DataFrame:
    """rows with the column of that name of their cell."""
    told = cells.select(F.col("cluster_id").alias("told_id"), F.col("cell").alias("told_cell"), name)
    return rows.join(told, F.col("cluster_id").eqNullSafe(F.col("told_id")) & (F.col("cell") == F.col("told_cell"))).drop("told_id", "told_cell")


def golden_records(clients: DataFrame, trust: tuple[str, ...] = TRUST, stale_hours: int = 30 * 24, scratch: Scratch | None = None) -> DataFrame:
    """cluster_id, n_records, n_stale, name, email, segment, city, nation_id, balance_cents, and of each field the client_id it comes from."""
    scratch = scratch or Scratch(clients.sparkSession)
    filled = lambda c: F.when(F.btrim(F.col(c), F.lit(_BLANK)) != "", F.col(c)).alias(c)
    rank = F.coalesce(*[F.when(F.col("source") == s, len(trust) - i) for i, s in enumerate(trust)], F.lit(0))
    cents = 100 * F.col("balance").cast("double") + 0.5
    cents = F.when(F.abs(cents) < 2.0**63, F.floor(cents)).cast("long")  # neither NaN nor an infinity is less
    rows = clients.select(
        F.col("client_id").cast("long").alias("client_id"), F.coalesce("master_id", "client_id").cast("long").alias("cluster_id"), rank.alias("trust"), "updated_at", filled("name"), filled("email"), filled("segment"), filled("city"), "nation_id", cents.alias("cents"), F.xxhash64(F.monotonically_increasing_id()).alias("dealt")
    )
    rows = scratch.keep("rows", rows)
    n_cells = int(rows.count() ** 0.5) + 1
    rows = rows.withColumn("cell", F.pmod("dealt", F.lit(n_cells))).drop("dealt")
    cluster, cell = ["cluster_id"], ["cluster_id", "cell"]
    over = Window.partitionBy(*cluster)
    latest = rows.groupBy(*cell).agg(F.max("updated_at").alias("cell_latest")).withColumn("latest", F.max("cell_latest").over(over))
    dated = _told(rows, latest, "latest")
    dated = dated.withColumn("stale", F.col("updated_at").isNull() | (F.col("latest") - F.col("updated_at") > F.expr(f"make_dt_interval(0, {int(stale_hours)})")))
    by = ["stale", "trust", "updated_at", "client_id"]
    candidates = dated.select(
        *cell,
        F.lit(1).alias("n_records"),
        F.col("stale").cast("long").alias("n_stale"),
        *[F.struct(F.col(f).alias("value"), *by).alias(f) for f in ("name", "email", "segment")],
        F.struct(F.col("city").alias("value"), "nation_id", (F.col("city").isNotNull().cast("int") + F.col("nation_id").isNotNull().cast("int")).alias("filled"), *by).alias("address"),
    )
    counts = ["n_records", "n_stale"]
    winners = scratch.keep("winners", _collapse(candidates, cell, counts))
    of_cluster = winners.withColumn("rank", F.row_number().over(over.orderBy(*ORDERS["segment"](F.col("segment"))))).withColumn("chosen", F.max(F.when(F.col("rank") == 1, F.col("segment.value"))).over(over))
    chosen = _told(rows, of_cluster, "chosen")
    other = ~F.coalesce(F.col("segment") == F.col("chosen"), F.lit(False))
    balances = chosen.select(*cell, F.struct(F.col("cents").alias("value"), other.alias("other"), "trust", "updated_at", "client_id").alias("balance"))
    balances = _collapse(_collapse(balances, cell, []), cluster, []).select(F.col("cluster_id").alias("balance_id"), "balance")
    found = _collapse(winners, cluster, counts).join(balances, F.col("cluster_id").eqNullSafe(F.col("balance_id")))
    source = lambda f: F.when(F.col(f"{f}.value").isNotNull(), F.col(f"{f}.client_id")).alias(f"{f}_from")
    return found.select(
        "cluster_id", "n_records", "n_stale", *[F.col(f"{f}.value").alias(f) for f in ("name", "email", "segment")], F.col("address.value").alias("city"), F.col("address.nation_id").alias("nation_id"), F.col("balance.value").alias("balance_cents"),
        *[source(f) for f in ("name", "email", "segment", "balance")], F.when(F.col("address.filled") > 0, F.col("address.client_id")).alias("address_from"),
    )


_FILLED = "case when trim({0}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' then {0} end as {0}"
_RECENT = "updated_at desc nulls last, trust desc, client_id nulls last"
#: DuckDB SQL for the rows of golden_records with the default parameters.
SQL = f"""
with r as (select client_id, coalesce(master_id, client_id) as cluster_id, updated_at, nation_id, {", ".join(map(_FILLED.format, ("name", "email", "segment", "city")))},
    case when isfinite(balance) and abs(100 * balance + 0.5) < 9223372036854775808 then floor(100 * balance + 0.5)::bigint end as cents,
    case source when 'partner' then 4 when 'store' then 3 when 'web' then 2 when 'crm' then 1 else 0 end as trust from clients),
l as (select *, max(updated_at) over (partition by cluster_id) as latest from r),
t as (select *, updated_at is null or epoch_us(latest) - epoch_us(updated_at) > {30 * 24 * 3_600_000_000} as stale from l),
w as (select *, row_number() over (partition by cluster_id order by segment is null, {_RECENT}, segment) as n_segment,
    row_number() over (partition by cluster_id order by email is null, stale, trust desc, {_RECENT}, email) as n_email,
    row_number() over (partition by cluster_id order by name is null, length(name) desc, stale, trust desc, {_RECENT}, name) as n_name,
    row_number() over (partition by cluster_id order by (city is not null)::int + (nation_id is not null)::int desc, stale, trust desc, {_RECENT}, city nulls last, nation_id nulls last) as n_address from t),
c as (select *, max(case when n_segment = 1 then segment end) over (partition by cluster_id) as chosen from w),
b as (select *, row_number() over (partition by cluster_id order by cents is null, coalesce(segment = chosen, false) desc, {_RECENT}, cents) as n_balance from c)
select cluster_id, count(*) as n_records, count(*) filter (stale) as n_stale, max(name) filter (n_name = 1) as name, max(email) filter (n_email = 1) as email, max(segment) filter (n_segment = 1) as segment,
    max(city) filter (n_address = 1) as city, max(nation_id) filter (n_address = 1) as nation_id, max(cents) filter (n_balance = 1) as balance_cents,
    max(client_id) filter (n_name = 1 and name is not null) as name_from, max(client_id) filter (n_email = 1 and email is not null) as email_from,
    max(client_id) filter (n_segment = 1 and segment is not null) as segment_from, max(client_id) filter (n_balance = 1 and cents is not null) as balance_from,
    max(client_id) filter (n_address = 1 and (city is not null or nation_id is not null)) as address_from
from b group by cluster_id
"""
