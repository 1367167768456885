"""Domain tables read row by row out of the given tables, and their SQL twins.

Every coordinate grows with its table, so densities stay the same at any scale. Nothing
here joins or ranks: one input row gives one interval, pair, gene or point.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.catalog.registry import cte
from loopweave.operators import annotation, contacts, tracks
from loopweave.session import bound_merging

RES = 3600
TRACKS = ["click", "error", "purchase", "signup", "view"]
# The replication phases in order.
PHASES = ["G1", "S1", "S2", "S3", "S4", "G2"]


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    bound_merging(spark)
    return spark.read.parquet(f"{d}/{name}.parquet")


def _chrom(key: Column | str) -> Column:
    key = F.col(key) if isinstance(key, str) else key
    return F.concat(F.lit("chr"), (key % 22 + 1).cast("string"))


# --- piecewise-constant tracks ------------------------------------------------------------
cte(
    "c_tracks",
    """
select 'chr'||(user_id%22+1) chrom, event_type track,
       event_id*360 + minute(ts)*60 + second(ts) st,
       event_id*360 + minute(ts)*60 + second(ts) + 7200 + (event_id*37)%57600 en,
       value, event_id from events""",
)


def raw_tracks(spark: SparkSession, d: str) -> DataFrame:
    start = F.col("event_id") * 360 + F.minute("ts") * 60 + F.second("ts")
    rows = table(spark, d, "events").select(
        _chrom("user_id").alias("chrom"),
        F.col("event_type").alias("track"),
        start.cast("bigint").alias("start"),
        (start + 7200 + (F.col("event_id") * 37) % 57600).cast("bigint").alias("end"),
        "value",
        "event_id",
    )
    return rows


cte(
    "c_tbins",
    """
select chrom, track, value, bin,
       least(en,(bin+1)*3600)-greatest(st,bin*3600) ov
from (select *, unnest(range(st//3600,(en-1)//3600+1)) bin from c_tracks)""",
)
cte(
    "c_binned",
    "select chrom, track, bin, sum(value*ov)/sum(ov) signal from c_tbins group by chrom,track,bin",
)


def binned(spark: SparkSession, d: str) -> DataFrame:
    """chrom, track, pos, value."""
    return tracks.bin_track(raw_tracks(spark, d), RES, keys=("track",))


cte("c_chroms", "select chrom, max(en) size from c_tracks group by chrom")
cte(
    "c_arms",
    """
select chrom, 'p' arm, size//2 + 1234 as size from c_chroms
union all select chrom, 'q' arm, size - (size//2 + 1234) as size from c_chroms""",
)


def chrom_sizes(spark: SparkSession, d: str) -> DataFrame:
    return raw_tracks(spark, d).groupBy("chrom").agg(F.max("end").alias("size"))


def arm_sizes(spark: SparkSession, d: str) -> DataFrame:
    p_size = F.expr("size div 2 + 1234")
    return chrom_sizes(spark, d).select(
        "chrom",
        F.explode(
            F.array(
                F.struct(F.lit("p").alias("arm"), p_size.alias("size")),
                F.struct(F.lit("q").alias("arm"), (F.col("size") - p_size).alias("size")),
            )
        ).alias("a"),
    ).select("chrom", "a.arm", "a.size")


# --- per-bin annotation: the track with the largest covered sum ----------------------------
cte(
    "c_tsum",
    """select chrom, bin, track, round(sum(value*ov),4) sv from c_tbins
group by chrom,bin,track""",
)
cte(
    "c_label",
    """
select chrom, bin pos, track as label from (
  select *, row_number() over (partition by chrom,bin order by sv desc, track) rn
  from c_tsum) where rn=1""",
)


def labels(spark: SparkSession, d: str) -> DataFrame:
    """chrom, pos, label with one row per labelled bin."""
    weights = tracks.overlap_sums(raw_tracks(spark, d), RES, keys=("track",))
    return annotation.heaviest_label(
        weights.withColumn("weight", F.round("weighted", 4)),
        ["chrom", "pos"],
        label="track",
        tie=F.col("track"),
    ).select("chrom", "pos", F.col("track").alias("label"))


cte(
    "c_label_idx",
    """
select row_number() over (order by cast(substr(chrom,4) as int), pos)-1 idx, chrom, pos, label
from c_label""",
)
cte(
    "c_seg",
    """
select chrom, min(pos)*3600 st, (max(pos)+1)*3600 en, min(label) as label from (
  select *, sum(s) over (partition by chrom order by pos rows unbounded preceding) seg from (
    select *, case when lag(label) over w = label and lag(pos) over w = pos-1 then 0 else 1 end s
    from c_label window w as (partition by chrom order by pos)))
group by chrom, seg""",
)


def segments(spark: SparkSession, d: str) -> DataFrame:
    return annotation.segments(labels(spark, d), RES)


# a second annotation of the same bins, for comparisons of two annotations
cte(
    "c_label2",
    """
select chrom, bin pos, track as label from (
  select *, row_number() over (partition by chrom,bin order by n desc, track) rn from (
    select chrom, bin, track, sum(ov) n from c_tbins group by chrom,bin,track)) where rn=1""",
)


def labels2(spark: SparkSession, d: str) -> DataFrame:
    weights = tracks.overlap_sums(raw_tracks(spark, d), RES, keys=("track",))
    return annotation.heaviest_label(
        weights.withColumn("weight", F.col("covered")),
        ["chrom", "pos"],
        label="track",
        tie=F.col("track"),
    ).select("chrom", "pos", F.col("track").alias("label"))


# --- genes, replication timing, reference intervals, paired regions -----------------------
cte(
    "c_genes",
    """
select p_partkey gene_id, 'chr'||(p_partkey%22+1) chrom,
       p_partkey*1800 + (p_partkey*7919)%3600 st,
       p_partkey*1800 + (p_partkey*7919)%3600 + 1 + (p_partkey*104729)%20000 en,
       p_retailprice expr from part""",
)


def genes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    start = key * 1800 + (key * 7919) % 3600
    return table(spark, d, "part").select(
        key.alias("gene_id"),
        _chrom(key).alias("chrom"),
        start.alias("start"),
        (start + 1 + (key * 104729) % 20000).alias("end"),
        F.col("p_retailprice").alias("expr"),
    )


cte(
    "c_rt",
    """
select o_orderkey point_id, 'chr'||(o_custkey%22+1) chrom, o_orderkey*240+500 pos,
"""
    + ",\n".join(
        f"cast((o_orderkey*{k * k + 3} + o_custkey*{k + 1})%97 as double) {p}"
        for k, p in enumerate(PHASES)
    )
    + " from orders",
)


def replication(spark: SparkSession, d: str) -> DataFrame:
    order, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(
        order.alias("point_id"),
        _chrom(cust).alias("chrom"),
        (order * 240 + 500).alias("pos"),
        *[
            ((order * (k * k + 3) + cust * (k + 1)) % 97).cast("double").alias(p)
            for k, p in enumerate(PHASES)
        ],
    )
    return rows


cte(
    "c_regions",
    """
select o_orderkey region_id, 'chr'||(o_custkey%22+1) chrom, o_orderkey*240 st,
       o_orderkey*240 + (5+o_orderkey%26)*3600 en from orders""",
)


def regions(spark: SparkSession, d: str) -> DataFrame:
    order = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(
        order.alias("region_id"),
        _chrom("o_custkey").alias("chrom"),
        (order * 240).alias("start"),
        (order * 240 + (F.lit(5) + order % 26) * 3600).alias("end"),
    )
    return rows


cte(
    "c_pairs",
    """
select 'chr'||(l_partkey%22+1) chrom1, l_partkey*1800 st1,
       l_partkey*1800 + 1 + (l_suppkey*311)%9000 en1,
       'chr'||(l_orderkey%22+1) chrom2, l_orderkey*240 st2,
       l_orderkey*240 + 1 + (l_suppkey*733)%9000 en2,
       cast(l_quantity as bigint) weight from lineitem""",
)


def pairs(spark: SparkSession, d: str) -> DataFrame:
    part, order, supp = F.col("l_partkey"), F.col("l_orderkey"), F.col("l_suppkey")
    rows = table(spark, d, "lineitem").select(
        _chrom(part).alias("chrom1"),
        (part * 1800).alias("start1"),
        (part * 1800 + 1 + (supp * 311) % 9000).alias("end1"),
        _chrom(order).alias("chrom2"),
        (order * 240).alias("start2"),
        (order * 240 + 1 + (supp * 733) % 9000).alias("end2"),
        F.col("l_quantity").cast("bigint").alias("weight"),
    )
    return rows


# --- contact map ---------------------------------------------------------------------------
cte(
    "c_dump",
    """
select chrom1, pos1, chrom2, pos2, sum(w) weight from (
  select case when sw then b%22+1 else a%22+1 end chrom1, case when sw then b//22 else a//22 end pos1,
         case when sw then a%22+1 else b%22+1 end chrom2, case when sw then a//22 else b//22 end pos2, w
  from (select a, b, w, (a%22,a//22) > (b%22,b//22) sw from (
    select l_partkey a, l_quantity w,
      case when l_linenumber%2=0 then (l_partkey//352)*352+(l_partkey%352+22*(1+l_suppkey%8))%352
           else (2*l_orderkey)//15 end b from lineitem)))
group by chrom1,pos1,chrom2,pos2""",
)


def dump(spark: SparkSession, d: str) -> DataFrame:
    """chrom1, pos1, chrom2, pos2, weight: chromosome numbers, binned, first end <= second."""
    part, order = F.col("l_partkey"), F.col("l_orderkey")
    near = part - part % 352 + (part % 352 + 22 * (F.lit(1) + F.col("l_suppkey") % 8)) % 352
    far = F.expr("(2 * l_orderkey) div 15")
    ends = table(spark, d, "lineitem").select(
        part.alias("a"),
        F.when(F.col("l_linenumber") % 2 == 0, near).otherwise(far).alias("b"),
        F.col("l_quantity").alias("weight"),
    )

    def locus(col: str) -> Column:
        return F.struct(
            (F.col(col) % 22 + 1).cast("bigint").alias("c"),
            F.floor(F.col(col) / 22).cast("bigint").alias("p"),
        )

    return (
        ends.select(
            F.least(locus("a"), locus("b")).alias("x"),
            F.greatest(locus("a"), locus("b")).alias("y"),
            "weight",
        )
        .groupBy(
            F.col("x.c").alias("chrom1"),
            F.col("x.p").alias("pos1"),
            F.col("y.c").alias("chrom2"),
            F.col("y.p").alias("pos2"),
        )
        .agg(F.sum("weight").alias("weight"))
    )


cte(
    "c_nodes",
    """
select chrom, pos, row_number() over (order by chrom,pos)-1 idx, price from (
  select p_partkey%22+1 chrom, p_partkey//22 pos, p_retailprice price from part
  where p_partkey%13<>5)""",
)


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """Valid bins of the contact map: chrom (number), pos, idx, price."""
    key = F.col("p_partkey")
    rows = table(spark, d, "part").select(
        (key % 22 + 1).cast("bigint").alias("chrom"),
        F.expr("p_partkey div 22").alias("pos"),
        F.col("p_retailprice").alias("price"),
        (key % 13 != 5).alias("valid"),
    )
    return contacts.index_bins(rows, rank="chrom", valid="valid")


cte(
    "c_edges",
    """
select n1.idx id1, n2.idx id2, weight from c_dump
join c_nodes n1 on n1.chrom=chrom1 and n1.pos=pos1
join c_nodes n2 on n2.chrom=chrom2 and n2.pos=pos2""",
)


def edges(spark: SparkSession, d: str) -> DataFrame:
    """id1, id2, weight with id1 <= id2, loops included."""
    return contacts.indexed_contacts(dump(spark, d), nodes(spark, d))


cte("c_pval", "select *, ((pos1*7919+pos2*104729+chrom1*31)%10007)/10007.0::double p from c_dump")


def significance(spark: SparkSession, d: str) -> DataFrame:
    score = (F.col("pos1") * 7919 + F.col("pos2") * 104729 + F.col("chrom1") * 31) % 10007
    return dump(spark, d).withColumn("pvalue", score / F.lit(10007.0))
