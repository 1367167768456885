"""Shards of near equal bytes by a k-d tree over document metadata; DataFrame functions only.

Equal texts form a group that stays in one shard. The tree starts with all groups. Every node is
split along its widest dimension (text length, doc_id, source, language; width is the weighted
deviation of the coordinate) at the weighted median of the bytes, found exactly enough by counting
bytes in ever finer intervals of the coordinate; ties of the coordinate go by a hash of the text.
All nodes of a level are counted in one pass. Splitting ends when leaves reach the target bytes.

Groups heavier than 1/64 of a leaf (a few hundred at most, by their weight) are placed one by one,
the heaviest first, on the lighter side, and the median of the others makes up for them. A group
heavier than a leaf cannot stay whole under equal sizes: its rows are dealt by a hash into parts.

Slots number the rows of a shard from 0, through bounded runs of rows and a table of run sizes.

Defined cases: a null text has no bytes (size 1, crc32 0), is one group, and its length is 0; null
metadata sort lowest; repeated rows are rows each; an empty table gives no rows. Extra columns are
ignored. Fewer groups than shards leave shards empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loopweave.llm.common import stored

GROUP = ["h", "crc", "size"]
DIMS = ["length", "place", "origin", "tongue"]
COORDINATE_BITS = 20
STEP_BITS = 12
KEY_BITS = 60
HEAVY_PARTS = 64
RUN = 1 << 14


def _rows(docs: DataFrame) -> DataFrame:
    def hashed(name: str) -> Column:
        return F.pmod(F.xxhash64(name), F.lit(1 << 16)) if name in docs.columns else F.lit(0)

    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text.cast("binary")), F.lit(0)).cast("long").alias("crc"),
        F.xxhash64(text).alias("h"),
        F.coalesce(F.length(text), F.lit(0)).cast("long").alias("length"),
        hashed("source").cast("long").alias("origin"),
        hashed("lang").cast("long").alias("tongue"),
        F.monotonically_increasing_id().alias("uid"),
    )


def _groups(rows: DataFrame) -> DataFrame:
    """One row per text: bytes, rows and, per dimension, a key of coordinate and hash (60 bits)."""
    sums = rows.groupBy(*GROUP).agg(
        F.sum("size").alias("w"),
        F.min("length").alias("length"),
        F.min("doc_id").alias("place"),
        F.min("origin").alias("origin"),
        F.min("tongue").alias("tongue"),
    )
    sums = stored(sums, "shard-groups")
    ends = sums.agg(*[F.min(d).alias(f"{d}_lo") for d in DIMS], *[F.max(d).alias(f"{d}_hi") for d in DIMS]).first()
    tie = F.shiftrightunsigned(F.xxhash64("h", "crc"), 64 - (KEY_BITS - COORDINATE_BITS))
    keys = []
    for d in DIMS:
        low, high = ends[f"{d}_lo"] or 0, ends[f"{d}_hi"] or 0
        share = (F.coalesce(F.col(d), F.lit(low)) - low).cast("double") / max(high - low, 1)
        cell = F.least(F.floor(share * (1 << COORDINATE_BITS)), F.lit((1 << COORDINATE_BITS) - 1))
        keys.append((cell * F.lit(1 << (KEY_BITS - COORDINATE_BITS)) + tie).alias(d))
    return stored(sums.select(*GROUP, "w", *keys), "shard-keys")


def _medians(light: DataFrame, node: Column, wanted: dict[int, tuple[str, float]]) -> dict[int, int]:
    """Per node the key below which about the wanted bytes lie. ``wanted``: node -> (dimension, bytes)."""
    key = F.lit(None).cast("long")
    for n, (dim, _) in wanted.items():
        key = F.when(node == n, F.col(dim)).otherwise(key)
    keyed = light.select(node.alias("node"), key.alias("key"), "w").dropna()
    low = {n: 0 for n in wanted}
    left = {n: most for n, (_, most) in wanted.items()}
    for shift in range(KEY_BITS - STEP_BITS, -1, -STEP_BITS):
        span = 1 << (shift + STEP_BITS)
        inside = F.lit(False)
        base = F.lit(0).cast("long")
        for n in wanted:
            inside = inside | ((F.col("node") == n) & (F.col("key") >= low[n]) & (F.col("key") < low[n] + span))
            base = F.when(F.col("node") == n, F.lit(low[n]).cast("long")).otherwise(base)
        cells = (
            keyed.filter(inside)
            .groupBy("node", F.shiftright(F.col("key") - base, shift).alias("cell"))
            .agg(F.sum("w").alias("w"))
            .collect()
        )
        for n in wanted:
            own = sorted((r["cell"], r["w"]) for r in cells if r["node"] == n)
            at = 0
            for cell, w in own:
                at = cell
                if left[n] < w:
                    break
                left[n] -= w
                at = cell + 1
            low[n] += at << shift
    # What is left over belongs to one key at most: round to the nearer side.
    return low


def _deal(heavy: list[tuple], node_of: dict[tuple, int]) -> dict[int, list[float]]:
    """Put every heavy group on the lighter side of its node; bytes on either side by node."""
    sides: dict[int, list[float]] = {}
    for key, w in sorted(heavy, key=lambda p: (-p[1], p[0])):
        node = node_of[key]
        own = sides.setdefault(node, [0.0, 0.0])
        side = 0 if own[0] <= own[1] else 1
        own[side] += w
        node_of[key] = 2 * node + side
    return sides


def kd_shards(docs: DataFrame, target_bytes: int | None = None, leaves: int | None = None) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. Give the bytes of a leaf, or the number of leaves (a power of two)."""
    spark = docs.sparkSession
    rows = stored(_rows(docs), "shard-rows")
    groups = _groups(rows)
    total = groups.agg(F.sum("w")).first()[0] or 0
    if leaves is None:
        leaves = 1 << max(0, (-(-total // max(target_bytes, 1)) - 1).bit_length())
    levels = leaves.bit_length() - 1
    limit = max(total / leaves / HEAVY_PARTS, 1.0)
    heavy_rows = groups.filter(F.col("w") > limit).select(*GROUP, "w").collect()
    light = groups.filter(F.col("w") <= limit)
    parts = {tuple(r[c] for c in GROUP): (1 if r["w"] <= total / leaves else int(-(-r["w"] // limit))) for r in heavy_rows}
    heavy = [((*key, p), float(r["w"]) / parts[key]) for r in heavy_rows for key in [tuple(r[c] for c in GROUP)] for p in range(parts[key])]
    node_of = {key: 0 for key, _ in heavy}
    node = F.lit(0)
    for level in range(levels):
        unit = {d: F.col(d).cast("double") / float(1 << KEY_BITS) for d in DIMS}
        mean = {d: F.sum(F.col("w") * unit[d]) / F.sum("w") for d in DIMS}
        square = {d: F.sum(F.col("w") * unit[d] * unit[d]) / F.sum("w") for d in DIMS}
        spread = light.groupBy(node.alias("node")).agg(
            F.sum("w").alias("w"), *[(square[d] - mean[d] * mean[d]).alias(d) for d in DIMS]
        )
        found = {r["node"]: r for r in spread.collect()}
        sides = _deal(heavy, node_of)
        wanted = {}
        for n, r in found.items():
            own = sides.get(n, [0.0, 0.0])
            most = min(max((r["w"] + sum(own)) / 2 - own[0], 0.0), float(r["w"]))
            wanted[n] = (max(DIMS, key=lambda d: r[d]), most)
        cuts = _medians(light, node, wanted)
        side = F.lit(0)
        for n, (dim, _) in wanted.items():
            side = F.when(node == n, (F.col(dim) >= cuts[n]).cast("int")).otherwise(side)
        light = light.withColumn("node", (node * 2 + side).cast("int"))
        light = stored(light, "shard-nodes")
        node = F.col("node")
    placed = light.select(*GROUP, node.cast("int").alias("shard"))
    dealt = rows.select("doc_id", "uid", *GROUP)
    if heavy:
        lines = ", ".join(f"({h}L, {c}L, {s}L, {parts[(h, c, s)]}, {p}, {node_of[(h, c, s, p)]})" for (h, c, s, p), _ in heavy)
        listed = spark.sql(f"select * from values {lines} as t(h, crc, size, parts, part, heavy_shard)")
        counts = listed.select(*GROUP, "parts").distinct()
        known = dealt.join(F.broadcast(counts), GROUP, "left").withColumn(
            "part", F.pmod(F.xxhash64("doc_id", "uid"), F.coalesce("parts", F.lit(1))).cast("int")
        )
        known = known.join(F.broadcast(listed.drop("parts")), [*GROUP, "part"], "left").drop("parts", "part")
        dealt = known.filter("heavy_shard is null").drop("heavy_shard").join(placed, GROUP).unionByName(
            known.filter("heavy_shard is not null").withColumnRenamed("heavy_shard", "shard")
        )
    else:
        dealt = dealt.join(placed, GROUP)
    dealt = stored(dealt.withColumn("run", F.floor(F.col("uid") / RUN)), "shard-dealt")
    return numbered(dealt).select("doc_id", "size", F.col("crc").alias("text_crc32"), "shard", "slot")


def numbered(dealt: DataFrame) -> DataFrame:
    """``dealt(shard, run, uid)`` with slot, gapless from 0 in every shard."""
    runs = dealt.groupBy("shard", "run").count()
    before = Window.partitionBy("shard").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.select("shard", "run", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("shard", "run").orderBy("uid")
    return dealt.withColumn("at", F.row_number().over(inside) - 1).join(offsets, ["shard", "run"]).withColumn(
        "slot", (F.col("at") + F.col("offset")).cast("long")
    )
