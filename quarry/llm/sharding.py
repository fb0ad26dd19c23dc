"""Balanced label propagation: linked documents move to common shards, sizes stay even.

Documents with equal texts are linked.  A group hangs on one hub (its text
digest) instead of pairs: the unit of movement is a cell, the documents of
a group that began in one shard.  In each round a join brings every cell
its group's weight in each shard; the cells ask for the shard that holds
most of their group (the emptier one of equals), and quotas from the loads
(24 numbers) decide which share of the requests is granted, by a hash of
the group, so that a group moves as a whole.

A group that is larger than a shard first fills whole shards (there are
fewer such groups than shards) and only its rest takes part.

The law is ``rows``: shards differ by one row at most.  In the end each
shard seats its linked documents, as far as it has seats, and documents
without links (and those beyond the seats) fill up.  All ranks are counts
of hash blocks plus a rank inside a block, so no task holds a shard.

Null texts are empty (size 8, linked with other empty ones).  Repeated rows
get a seat each.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.common import exact, stored, text_column

SHARDS = 24
ROUNDS = 8
#: bytes that a document takes besides its text
OVERHEAD = 8
BLOCK_ROWS = 256
#: rows of a group that is not cut at a shard's last seat
SMALL = 64
MAX_BLOCKS = 1 << 16


def _unit(*cols: Column | str) -> Column:
    """A hash in [0, 1)."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11) / F.lit(float(1 << 53))


def _ranked(rows: DataFrame, part: str, out: str, name: str) -> DataFrame:
    """Adds the rank from 0 within ``part``, in the order of the blocks (block, sub)."""
    rows = stored(rows, name)
    at = [part, "block", "sub"]
    counts = rows.groupBy(*at).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(part).orderBy("block", "sub").rowsBetween(Window.unboundedPreceding, -1)
    heads = counts.select(*at, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy(*at).orderBy("order_g", "g", "order_d", "doc_id"))
    return rows.withColumn("_own", own).join(heads, at).withColumn(out, F.col("_before") + F.col("_own") - 1).drop("_own", "_before")


def _pick(values: list[int], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def propagate(cells: DataFrame, shards: list[int], quota: int, rounds: int = ROUNDS) -> DataFrame:
    """Labels for cells (g, origin, c, label): at most ``quota`` rows to a shard, groups together."""
    best_cut = None
    for turn in range(rounds):
        load = {r.label: r.c for r in cells.groupBy("label").agg(F.sum("c").alias("c")).collect()}      # one for each shard
        room = F.create_map(*[x for s in shards for x in (F.lit(s), F.lit(0.9 * max(0.0, 1 - load.get(s, 0) / max(quota, 1))))])
        weight = cells.groupBy("g", "label").agg(F.sum("c").alias("w"))
        wish = weight.groupBy("g").agg(F.max(F.struct((F.col("w") + room[F.col("label")]).alias("score"), "label")).alias("b")) \
            .select("g", F.col("b.label").alias("wish"))
        asked = stored(cells.join(wish, "g"), "shard-wishes")
        flow = {(r.label, r.wish): r.c for r in asked.filter("label <> wish").groupBy("label", "wish").agg(F.sum("c").alias("c")).collect()}
        cut = sum(flow.values())
        if not cut or cut == best_cut:
            return cells
        best_cut = cut
        leaving = {s: sum(c for (a, _), c in flow.items() if a == s) for s in shards}
        coming = {s: sum(c for (_, b), c in flow.items() if b == s) for s in shards}
        grant = {s: min(1.0, (max(0, quota - load.get(s, 0)) + leaving[s] / 2) / coming[s]) if coming[s] else 0.0 for s in shards}
        share = F.create_map(*[x for s in shards for x in (F.lit(s), F.lit(grant[s]))])
        moved = _unit(F.lit(turn), "g") < share[F.col("wish")]
        cells = asked.withColumn("label", F.when(moved, F.col("wish")).otherwise(F.col("label"))).drop("wish")
    return cells


def shard(docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard (null)."""
    docs = exact(docs, id_col, text_col)
    text = text_column(docs, text_col)
    slim = stored(docs.select(F.col(id_col).alias("doc_id"), (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
                              F.crc32(text).alias("text_crc32"), F.md5(text).alias("g")), "shard-docs")
    n = slim.count()
    seats = [n // shards + (s < n % shards) for s in range(shards)]
    quota = max(1, n // shards)
    sizes = stored(slim.groupBy("g").agg(F.count("*").alias("n")).filter("n > 1"), "shard-groups")

    # groups larger than a shard: fewer than there are shards
    reserved: dict[str, tuple[int, int]] = {}
    used = 0
    if n >= shards:
        for r in sizes.filter(F.col("n") > quota).orderBy(F.desc("n"), "g").collect():
            reserved[r.g] = (used, r.n)
            used += r.n // quota
    free = list(range(min(used, shards), shards)) or [shards - 1]
    u = _unit(F.lit("seat"), "doc_id", "text_crc32")
    fixed = F.lit(None).cast("int")
    for g, (first, size) in reserved.items():
        piece = F.floor(u * (size / quota)).cast("int")
        fixed = F.when((F.col("g") == g) & (piece < size // quota), piece + first).otherwise(fixed)
    placed = slim.withColumn("fixed", fixed).withColumn("origin", _pick(free, F.floor(_unit(F.lit("origin"), "doc_id") * len(free))))
    linked = placed.filter("fixed IS NULL").join(sizes, "g")
    cells = stored(linked.groupBy("g", "origin").agg(F.count("*").alias("c"), F.first("n").alias("n"))
                   .withColumn("label", F.col("origin")), "shard-cells")
    cells = propagate(cells, free, quota, rounds)

    blocks = min(MAX_BLOCKS, -(-n // BLOCK_ROWS) or 1)
    labelled = placed.join(cells.select("g", "origin", "label", "n"), ["g", "origin"], "left")
    biggest = F.lit(None).cast("long")
    for g, (_, size) in reserved.items():
        biggest = F.when(F.col("g") == g, F.lit(size)).otherwise(biggest)
    many = F.coalesce("n", biggest, F.lit(1))
    parts = F.least(F.lit(MAX_BLOCKS), F.ceil(many / BLOCK_ROWS))
    ordered = labelled.withColumn("label", F.coalesce("fixed", "label")) \
        .withColumn("order_g", _unit("g")).withColumn("order_d", _unit(F.lit("seat"), "doc_id", "text_crc32")) \
        .withColumn("block", F.floor(F.col("order_g") * F.lit(blocks)).cast("int")) \
        .withColumn("sub", F.floor(F.col("order_d") * parts).cast("int")) \
        .select("doc_id", "size", "text_crc32", "g", "label", "order_g", "order_d", "block", "sub", many.alias("many"))
    ordered = stored(ordered, "shard-labels")
    linked_rank = stored(_ranked(ordered.filter("label IS NOT NULL"), "label", "rank", "shard-linked"), "shard-ranks")
    last = _pick(seats, F.col("label"))
    # a small group across a shard's last seat leaves it whole; at most two rows for each shard
    edge: dict[int, list[str]] = {}
    for r in linked_rank.filter((F.col("rank") == last - 1) | (F.col("rank") == last)).filter(F.col("many") <= SMALL).select("label", "g").collect():
        edge.setdefault(r.label, []).append(r.g)
    torn = F.lit(False)
    for label, gs in edge.items():
        if len(gs) == 2 and gs[0] == gs[1]:
            torn = torn | ((F.col("label") == label) & (F.col("g") == gs[0]))
    seated = stored(linked_rank.withColumn("seat", (F.col("rank") < last) & ~torn), "shard-seats")
    taken = {r.label: r.n for r in seated.filter("seat").groupBy("label").agg(F.count("*").alias("n")).collect()}
    pool = ordered.filter("label IS NULL").unionByName(seated.filter("NOT seat").select(ordered.columns)).withColumn("label", F.lit(shards))
    pool = _ranked(pool, "label", "rank", "shard-pool")
    starts, total = [], 0
    for s in range(shards):
        starts.append(total)
        total += seats[s] - taken.get(s, 0)
    home = sum((F.col("rank") >= F.lit(x)).cast("int") for x in starts[1:]) if shards > 1 else F.lit(0)
    filled = pool.withColumn("shard", home.cast("int")) \
        .withColumn("slot", F.col("rank") - _pick(starts, F.col("shard")) + _pick([taken.get(s, 0) for s in range(shards)], F.col("shard")))
    out = ["doc_id", "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot")]
    rows = seated.filter("seat").select("doc_id", "size", "text_crc32", F.col("label").alias("shard"), F.col("rank").alias("slot")) \
        .select(*out).unionByName(filled.select(*out))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
