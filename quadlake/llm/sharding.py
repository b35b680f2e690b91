"""Sharding by a K-d tree, law `bytes`: shards of near-equal sizes, each a box of the metadata space. DataFrame functions only.

Points: a group of equal texts is one point, weighted by the bytes of all its copies, so copies share a shard. Groups with over 1/BIG of all
bytes (BIG of them at most) would make medians coarse, so they're placed first, heaviest first, each whole in the shard with most room; only
one that fits in no shard, as a group that outweighs a shard, is dealt over several by the rows' hashes. A point's coordinates are the text's
size (logarithm), language and source, from its smallest document; below the value bits each has bits of the text's digest, so any
coordinate can be split anywhere.

Tree: at each of LEVELS levels every node is split at the weighted median of its widest dimension, all nodes at once; where big groups fill
shards unevenly, at the quantile that fills both sides alike. Width is the weighted range between the 5th and 95th percentile against
the root's range. Quantiles come from histograms of BINS bins a node and dimension, refined within the bin that holds the quantile till that
bin weighs under 1/FINE of the node; only these bounded histograms reach the driver.

Groups that many rows have are aggregated before their shuffle and joined with their rows by spread(), whatever their bytes.
Slots are counted within (shard, bucket) and offset by the buckets' counts, so no task sorts a shard.
Defined results: null text has size 1 and the checksum of the empty text; null language and source are a value of their own; repeated
rows have a slot each; a null doc_id is kept; no documents give no rows; ties in order are broken by doc_id, size and checksum; other columns,
whatever their names, are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Work, spread

SHARDS, LEVELS, BINS, VALUE_BITS, BITS, FINE, BUCKET_ROWS = 16, 4, 1024, 24, 40, 2000, 10_000
BIG = 4096
STEP = BINS.bit_length() - 1
DIMS = ("d_size", "d_lang", "d_source")


def base(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64("text").alias("digest"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"),
    )


def place_big(groups: list[tuple[int, int]], total: int) -> tuple[dict[int, list[int]], list[float]]:
    """For each big group (weight, digest) the shards it lies in, with a shard for each salt, and the room left in each shard."""
    share = total / SHARDS
    room, out = [share] * SHARDS, {}
    for w, digest in sorted(groups, key=lambda g: (-g[0], g[1])):
        best = max(range(SHARDS), key=lambda s: (room[s], -s))
        if w <= room[best]:
            out[digest], room[best] = [best], room[best] - w
            continue
        parts, left = [0] * SHARDS, float(w)  # in 1 / (16 * SHARDS) of the group
        unit = w / (16 * SHARDS)
        while left > unit / 2:
            s = max(range(SHARDS), key=lambda k: (room[k], -k))
            parts[s], room[s], left = parts[s] + 1, room[s] - unit, left - unit
        out[digest] = [s for s in range(SHARDS) for _ in range(parts[s])]
    return out, room


def _coordinate(value: Column, dim: int) -> Column:
    """value (under 2 ** VALUE_BITS) above bits of the digest."""
    low = F.pmod(F.xxhash64("digest", F.lit(dim)), F.lit(1 << (BITS - VALUE_BITS)))
    return F.shiftleft(value.cast("long"), BITS - VALUE_BITS) + low


def points(rows: DataFrame) -> DataFrame:
    """A weighted point for each digest; n: its rows."""
    grouped = rows.groupBy("digest").agg(F.sum("size").alias("w"), F.count("*").alias("n"), F.min(F.struct("doc_id", "size", "lang", "source")).alias("r"))
    letter = lambda k: F.ascii(F.substring(F.lower("r.lang"), k, 1)).bitwiseAND(31)
    top = 1 << VALUE_BITS
    return grouped.select(
        "digest", "w", "n", _coordinate(F.least(F.log2(F.col("r.size").cast("double")) * F.lit(float(1 << (VALUE_BITS - 6))), F.lit(float(top - 1))), 0).alias("d_size"),
        _coordinate((letter(1) * 1024 + letter(2) * 32 + letter(3)) * (top >> 15), 1).alias("d_lang"), _coordinate(F.pmod(F.xxhash64("r.source"), F.lit(top)), 2).alias("d_source"),
    )


def _node(splits: list[dict[int, tuple[str, int]]]) -> Column:
    """The node of a point after the levels split so far; node n has the children 2n and 2n + 1."""
    node = F.lit(1)
    for level in splits:
        right = F.lit(0)
        for n, (dim, cut) in level.items():
            right = F.when(node == n, (F.col(dim) >= cut).cast("int")).otherwise(right)
        node = node * 2 + right
    return node


def _histogram(at: DataFrame, shift: int, where: dict[int, tuple[str, int]] | None = None) -> dict[tuple[int, str], dict[int, int]]:
    """Weights by (node, dimension) and bin; where: for each node the one dimension, and the bits above shift + STEP that rows must have."""
    if where is None:
        dims = F.array(*[F.struct(F.lit(d).alias("d"), F.shiftright(F.col(d), shift).alias("b")) for d in DIMS])
    else:
        dims, here = F.array().cast("array<struct<d:string,b:bigint>>"), at
        for n, (d, high) in where.items():
            dims = F.when((F.col("node") == n) & (F.shiftright(F.col(d), shift + STEP) == high), F.array(F.struct(F.lit(d).alias("d"), F.shiftright(F.col(d), shift).alias("b")))).otherwise(dims)
        at = here
    out: dict[tuple[int, str], dict[int, int]] = {}
    for node, d, b, w in at.select("node", "w", F.explode(dims).alias("x")).groupBy("node", "x.d", "x.b").agg(F.sum("w")).collect():
        out.setdefault((node, d), {})[b] = w
    return out


def _crossing(bins: dict[int, int], need: float) -> tuple[int, int]:
    """The bin where the running weight first exceeds need, and the weight below it."""
    below = 0
    for b in sorted(bins):
        if below + bins[b] > need:
            return b, below
        below += bins[b]
    return max(bins), below - bins[max(bins)]


def _range(bins: dict[int, int]) -> int:
    total = sum(bins.values())
    return _crossing(bins, 0.95 * total)[0] - _crossing(bins, 0.05 * total)[0]


def tree(at: DataFrame, room: list[float] | None = None, levels: int = LEVELS) -> list[dict[int, tuple[str, int]]]:
    """For each level the split (dimension, smallest coordinate on the right) of each node; room: what each leaf shall hold, in proportion."""
    room = room or [1.0] * (1 << levels)
    splits: list[dict[int, tuple[str, int]]] = []
    root: dict[str, int] = {}
    for level in range(levels):
        wide = 1 << (levels - level)

        def part(n: int, level: int = level, wide: int = wide) -> float:
            """The share of a node's weight that goes left."""
            own = [max(0.0, r) for r in room[(n - (1 << level)) * wide :][:wide]]
            return sum(own[: wide // 2]) / sum(own) if sum(own) else 0.5

        placed, shift = at.select("w", *DIMS, _node(splits).alias("node")), BITS - STEP
        bins = _histogram(placed, shift)
        root = root or {d: max(1, _range(bins[1, d])) if (1, d) in bins else 1 for d in DIMS}
        nodes = sorted({n for n, _ in bins})
        dim = {n: max(DIMS, key=lambda d: (_range(bins[n, d]) / root[d], -DIMS.index(d))) for n in nodes}
        total = {n: sum(bins[n, dim[n]].values()) for n in nodes}
        need = {n: total[n] * part(n) for n in nodes}
        below, cut, live = dict.fromkeys(nodes, 0), {}, {n: bins[n, dim[n]] for n in nodes}
        while live:
            deeper = {}
            for n, own in live.items():
                b, less = _crossing(own, need[n] - below[n])
                below[n] += less
                if shift == 0 or own[b] * FINE <= total[n]:
                    nearer = abs(below[n] + own[b] - need[n]) < abs(need[n] - below[n])  # which side of the last bin is nearer
                    cut[n] = (b + nearer) << shift
                else:
                    deeper[n] = (dim[n], b)
            if deeper:
                shift -= STEP
                found = _histogram(placed, shift, deeper)
                live = {n: found[n, dim[n]] for n in deeper}
            else:
                live = {}
        splits.append({n: (dim[n], cut[n]) for n in nodes})
    return splits


def shard(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard (null under this law) of every document."""
    spark, work = docs.sparkSession, Work(docs.sparkSession, "sharding")
    rows = work.put(base(docs))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    at = work.put(points(rows))
    big = at.filter((F.col("w") * BIG > total) & (F.col("n") > 1))
    shards, room = place_big([(r["w"], r["digest"]) for r in big.select("w", "digest").collect()], total)
    rows_of = json.dumps([{"digest": k, "shards": v} for k, v in sorted(shards.items())])  # under BIG rows
    table = spark.range(1).select(F.explode(F.from_json(F.lit(rows_of), "array<struct<digest:bigint,shards:array<int>>>")).alias("x")).select("x.*")
    small = at.join(F.broadcast(table), "digest", "left_anti")
    placed = small.select("digest", F.array((_node(tree(small, room)) - SHARDS).cast("int")).alias("shards"), F.col("n").alias("_n"))
    placed = work.put(placed.unionByName(big.join(F.broadcast(table), "digest").select("digest", "shards", F.col("n").alias("_n"))))
    salt = F.pmod(F.xxhash64("doc_id", "source", "lang", F.lit(7)), F.size("shards")).cast("int")
    buckets = max(1, n // SHARDS // BUCKET_ROWS)
    out = spread(rows, placed, ["digest"], n).withColumn("shard", F.get("shards", salt)).withColumn("bucket", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets)))
    counts = out.groupBy("shard", "bucket").count()
    before = counts.withColumn("before", F.sum("count").over(Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))).select("shard", "bucket", F.coalesce("before", F.lit(0)).alias("before"))
    slot = F.row_number().over(Window.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32", "source", "lang")) - 1
    return out.withColumn("slot", slot).join(before, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("slot") + F.col("before")).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
