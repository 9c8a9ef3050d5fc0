"""Conflict-constrained best-fit packing of documents into bins of a fixed capacity.

A bin never holds two pieces of one source or of one duplicate cluster.  Sizes
are code points.  A document over the capacity fills bins of its own with whole
pieces; its rest, and every shorter document, is packed.

Documents are dealt over shards of about ``shard_rows`` rows by a hash of id
and row, so a source or cluster with a third of all rows is spread evenly and a
shard's state is bounded at any size of the input.  Inside a shard the pieces
go in order of falling size (then id).  Open bins stand ordered by residual and
carry two bitmaps, of their sources and of their clusters; from the smallest
residual that suffices the search goes on to the successor until both bitmaps
are free of conflict, so the tightest compatible bin is found, or a new one is
opened.

Defined cases: a null source or cluster never conflicts; a null or empty text
has size 0 and still gets a bin; equal rows are placed each for itself; a null
id is an ordinary id, before all others; ids and clusters of any size stay exact.
"""

from __future__ import annotations

from bisect import bisect_left, insort

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_of

CAPACITY = 8192
SHARD_ROWS = 4096
_OUT = "doc_id long, piece int, bin_id long, slot int, start long, length long"


def best_fit(items: list[tuple[int, object, object]], capacity: int) -> list[tuple[int, int]]:
    """Bin and slot of each ``(size, source, cluster)``, taken in the given order; sizes must fit."""
    bits: tuple[dict, dict] = ({}, {})
    sources, clusters, counts = [], [], []
    order: list[tuple[int, int]] = []  # (residual, bin) of the open bins
    placed = []
    for size, source, cluster in items:
        s = 0 if source is None else 1 << bits[0].setdefault(source, len(bits[0]))
        c = 0 if cluster is None else 1 << bits[1].setdefault(cluster, len(bits[1]))
        at = bisect_left(order, (size, -1))
        while at < len(order) and (sources[order[at][1]] & s or clusters[order[at][1]] & c):
            at += 1
        if at < len(order):
            residual, b = order.pop(at)
        else:
            residual, b = capacity, len(counts)
            sources.append(0)
            clusters.append(0)
            counts.append(0)
        sources[b] |= s
        clusters[b] |= c
        placed.append((b, counts[b]))
        counts[b] += 1
        insort(order, (residual - size, b))
    return placed


def _pack_shard(capacity: int):
    def run(key, pdf):
        import pandas as pd

        shard = int(key[0])
        pdf = pdf.sort_values(["rest", "known", "id", "row_hash"], ascending=[False, True, True, True], kind="stable")
        # a cluster that stands once in the shard cannot conflict and needs no bit
        twice = pdf["cluster"].duplicated(keep=False) & pdf["cluster"].notna()
        clusters = [c if t else None for c, t in zip(pdf["cluster"].tolist(), twice.tolist(), strict=True)]
        sources = [None if x is None or x != x else x for x in pdf["source"].tolist()]
        sizes = pdf["rest"].tolist()
        rows, full = [], pdf["full"].tolist()
        ids = [i if known else None for i, known in zip(pdf["id"].tolist(), pdf["known"].tolist(), strict=True)]
        open_rows = [i for i in range(len(pdf)) if sizes[i] or not full[i]]
        for i, (b, slot) in zip(open_rows, best_fit([(sizes[i], sources[i], clusters[i]) for i in open_rows], capacity), strict=True):
            rows.append((ids[i], full[i], b, slot, full[i] * capacity, sizes[i]))
        own = max((r[2] for r in rows), default=-1) + 1
        for i in range(len(pdf)):
            for k in range(full[i]):
                rows.append((ids[i], k, own, 0, k * capacity, capacity))
                own += 1
        out = pd.DataFrame(rows, columns=["doc_id", "piece", "bin_id", "slot", "start", "length"])
        out["doc_id"] = pd.array([r[0] for r in rows], dtype="Int64")
        out["bin_id"] = out["bin_id"].astype("int64") + (shard << 32)
        return out

    return run


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, cluster: Column | None = None, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``doc_id, piece, bin_id, slot, start, length``: where each piece of each document goes.

    ``start`` and ``length`` are the piece's code points in the text.  The
    default cluster is the group of equal texts.
    """
    text = text_of(docs)
    # no null number reaches pandas, which would make floats of the column
    doc_id = docs["doc_id"].cast("long")
    rows = docs.select(
        F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNotNull().alias("known"), (docs["source"].cast("string") if "source" in docs.columns else F.lit(None).cast("string")).alias("source"),
        (F.xxhash64(text) if cluster is None else cluster).cast("string").alias("cluster"), F.xxhash64(text).alias("row_hash"), F.length(text).cast("long").alias("n"),
    )
    shards = max(1, -(-docs.count() // shard_rows))
    dealt = rows.select("id", "known", "source", "cluster", "row_hash", F.floor(F.col("n") / capacity).cast("long").alias("full"), (F.col("n") % capacity).alias("rest"), F.pmod(F.xxhash64("id", "known", "row_hash"), F.lit(shards)).cast("int").alias("shard"))
    return dealt.groupBy("shard").applyInPandas(_pack_shard(capacity), _OUT)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))


#: Items in order are put into bins one after the other, as long as the table is one shard; every step hands the open bins on.
OP2_SQL = f"""
with recursive d as (select doc_id, source, coalesce(text, '') as text, length(coalesce(text, '')) as n from documents),
twice as (select text from d group by text having count(*) > 1),
o as (select doc_id, source, case when text in (select text from twice) then md5(text) end as cluster, n // {CAPACITY} as full_pieces, n % {CAPACITY} as rest, row_number() over (order by n % {CAPACITY} desc, doc_id) as turn from d),
items as (select *, row_number() over (order by turn) as i from o where rest > 0 or full_pieces = 0),
steps as (
  select cast(0 as bigint) as i, cast([] as struct(room bigint, sources varchar[], clusters varchar[], held bigint)[]) as bins, cast(null as bigint) as bin, cast(null as bigint) as slot
  union all
  select i, case when bin is null then list_append(bins, struct_pack(room := {CAPACITY} - rest, sources := case when source is null then cast([] as varchar[]) else [source] end, clusters := case when cluster is null then cast([] as varchar[]) else [cluster] end, held := cast(1 as bigint)))
    else list_concat(list_concat(bins[:bin], [struct_pack(room := bins[bin + 1].room - rest, sources := case when source is null then bins[bin + 1].sources else list_append(bins[bin + 1].sources, source) end,
      clusters := case when cluster is null then bins[bin + 1].clusters else list_append(bins[bin + 1].clusters, cluster) end, held := bins[bin + 1].held + 1)]), bins[bin + 2 :]) end,
    coalesce(bin, len(bins)), case when bin is null then 0 else bins[bin + 1].held end
  from (
    select items.i, bins, source, cluster, rest, list_sort(list_transform(list_filter(range(len(bins)), lambda k: bins[k + 1].room >= rest and (source is null or not list_contains(bins[k + 1].sources, source)) and (cluster is null or not list_contains(bins[k + 1].clusters, cluster))),
      lambda k: struct_pack(room := bins[k + 1].room, k := cast(k as bigint))))[1].k as bin
    from steps join items on items.i = steps.i + 1) t),
own as (select turn, doc_id, p as piece, (select coalesce(max(bin) + 1, 0) from steps) + row_number() over (order by turn, p) - 1 as bin_id from (select turn, doc_id, unnest(range(full_pieces)) as p from o where full_pieces > 0) x)
select items.doc_id, cast(full_pieces as bigint) as piece, cast(bin as bigint) as bin_id, cast(slot as bigint) as slot, cast(full_pieces * {CAPACITY} as bigint) as start, cast(rest as bigint) as length from steps join items on items.i = steps.i
union all select doc_id, piece, bin_id, 0, piece * {CAPACITY}, {CAPACITY} from own
"""
