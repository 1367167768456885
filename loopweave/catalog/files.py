"""Write the derived tables in each file format and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from loopweave.catalog.base import longs, r, rounded
from loopweave.catalog.domain import (
    PHASES, RES, TRACKS, chrom_sizes, binned, dump, genes, nodes, pairs, raw_tracks,
    replication, segments, significance, table,
)
from loopweave.catalog.graphs import graph
from loopweave.catalog.registry import cte, query
from loopweave.catalog.signals import valid_bins
from loopweave.catalog.vectors import instances, vectors
from loopweave.operators import tracks as tk
from loopweave.session import scratch_path
from loopweave.sources import readers as rd
from loopweave.sources import writers as wr
from loopweave.sources.graphs import numbered_edges, vertex_ids


@query("file_tracks", "select track, chrom, cast(bin as bigint) pos, round(signal,6)+0.0 as value from c_binned")
def file_tracks(spark, d):
    path = scratch_path(spark, "tracks")
    rows = raw_tracks(spark, d)
    for name in TRACKS:
        one = rows.filter(F.col("track") == name).select(
            F.concat_ws("\t", "chrom", "start", "end", "value").alias("value")
        )
        one.write.text(f"{path}/{name}")
    read = rd.read_tracks(spark, f"{path}/*")
    return rounded(tk.bin_track(read, RES, keys=("track",)).select("track", "chrom", "pos", "value"), "value")


@query("file_chrom_sizes", "select chrom, cast(size as bigint) size from c_chroms")
def file_chrom_sizes(spark, d):
    path = scratch_path(spark, "sizes")
    wr.write_tsv(chrom_sizes(spark, d), path, ["chrom", "size"])
    return rd.read_chrom_sizes(spark, path)


@query("file_annotation", "select chrom, st//3600 start, en//3600 \"end\", label from c_seg where chrom in ('chr1','chr2','chr11')")
def file_annotation(spark, d):
    path = scratch_path(spark, "annotation")
    wr.write_annotation(segments(spark, d), path)
    return rd.read_annotation(spark, path, RES, chroms=["chr1", "chr2", "chr11"])


@query("file_annotation_gz", "select chrom, st start, en \"end\", label from c_seg")
def file_annotation_gz(spark, d):
    path = scratch_path(spark, "annotation-gz")
    wr.write_tsv(segments(spark, d), path, ["chrom", "start", "end", "label"], gzip=True, header=True)
    return rd.read_annotation(spark, path, header=True)


@query("file_bins", "select chrom, pos*3600 start, (pos+1)*3600 \"end\", pos, idx own_index, idx from c_valid")
def file_bins(spark, d):
    path = scratch_path(spark, "bins")
    wr.write_bins_and_signals(valid_bins(spark, d), TRACKS, RES, path)
    return rd.read_bins(spark, f"{path}/bin", RES).select("chrom", "start", "end", "pos", "own_index", "idx")


@query("file_contacts", "select chrom1, pos1, chrom2, pos2, weight from c_dump")
def file_contacts(spark, d):
    path = scratch_path(spark, "contacts")
    wr.write_contacts(dump(spark, d), path, "oe", 1000)
    return rd.read_contacts(spark, f"{path}/*", 1000)


@query(
    "file_significance",
    "select 'chr'||chrom1 chrom1, pos1, 'chr'||chrom2 chrom2, pos2, round(p,6)+0.0 pvalue from c_pval",
)
def file_significance(spark, d):
    path = scratch_path(spark, "significance")
    out = significance(spark, d).select(
        F.concat(F.lit("chr"), "chrom1").alias("chr1"), (F.col("pos1") * 1000 + 500).alias("mid1"),
        F.concat(F.lit("chr"), "chrom2").alias("chr2"), (F.col("pos2") * 1000 + 500).alias("mid2"),
        F.col("weight").cast("bigint").alias("count"), "pvalue", F.lit(1.0).alias("q"),
    )
    wr.write_tsv(out, path, gzip=True, header=True)
    return rounded(rd.read_significance(spark, path, 1000), "pvalue")


@query(
    "file_paired_regions",
    "select chrom1, st1 start1, en1 end1, chrom2, st2 start2, en2 end2, weight from c_pairs",
)
def file_paired_regions(spark, d):
    path = scratch_path(spark, "pairs")
    wr.write_tsv(pairs(spark, d), path)
    return rd.read_paired_regions(spark, path)


@query("file_gene_expression", "select gene_id::varchar gene_id, chrom, st start, en \"end\", round(expr,6)+0.0 expr from c_genes")
def file_gene_expression(spark, d):
    path = scratch_path(spark, "genes")
    out = genes(spark, d).select(
        "gene_id", F.substring("chrom", 4, 9).alias("chr"), F.col("end").alias("a"), F.col("start").alias("b"), F.lit("+"), "expr"
    )
    wr.write_tsv(out, path)
    return rounded(rd.read_gene_expression(spark, path), "expr")


@query("file_timing", "select chrom, pos, " + ", ".join(PHASES) + " from c_rt")
def file_timing(spark, d):
    path = scratch_path(spark, "timing")
    wr.write_tsv(replication(spark, d), path, ["chrom", "pos", *PHASES])
    return rd.read_timing(spark, path, PHASES)


# phases of a point as whole percentages of 100, up to rounding
_SHARES = {p: f"(o_orderkey*{k + 3})%20" for k, p in enumerate(PHASES[:-1])}
cte(
    "c_wig",
    "select 'chr'||(o_orderkey%22+1) chrom, o_orderkey bin, "
    + ", ".join(f"{e} {p}" for p, e in _SHARES.items())
    + f", 100 - ({'+'.join(_SHARES.values())}) + (o_orderkey%7) - 3 G2 from orders",
)


@query(
    "file_timing_wigs",
    "select chrom, bin*1000+500 pos, " + ", ".join(f"{p}::bigint {p}" for p in PHASES)
    + f" from c_wig where abs({'+'.join(PHASES)}-100)<=2",
)
def file_timing_wigs(spark, d):
    path = scratch_path(spark, "wigs")
    key = F.col("o_orderkey")
    shares = {p: (key * (k + 3)) % 20 for k, p in enumerate(PHASES[:-1])}
    whole = sum(list(shares.values())[1:], shares["G1"])
    shares["G2"] = 100 - whole + key % 7 - 3
    points = table(spark, d, "orders").select((key % 22 + 1).alias("c"), key.alias("bin"), *[v.alias(k) for k, v in shares.items()])
    for p in PHASES:
        body = points.select("c", F.col("bin").alias("at"), F.concat_ws("\t", F.col("bin") * 1000, p).alias("value"))
        heads = points.select("c").distinct().select(
            "c", F.lit(-1).cast("bigint").alias("at"), F.concat(F.lit("variableStep chrom=chr"), "c").alias("value")
        )
        lines = heads.unionByName(body).orderBy("c", "at").select("value")
        lines.write.text(f"{path}/{p}")
    parts = [
        rd.read_timing_wig_lines(spark, f"{path}/{p}", p) for p in PHASES
    ]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return longs(rd.timing_table(rows, PHASES), *PHASES)


@query(
    "file_embedding",
    """select vec_id::varchar as name, k, round(embedding[k+1]::double,6)+0.0 x
    from (select vec_id, embedding, unnest(range(0,len(embedding))) k from embeddings)""",
)
def file_embedding(spark, d):
    path = scratch_path(spark, "embedding")
    wr.write_embedding(vectors(spark, d).select("idx", "vec"), path)
    out = rd.read_embedding(spark, path)
    return out.select("name", F.posexplode("vec").alias("k", "x")).select("name", F.col("k").cast("bigint").alias("k"), r("x").alias("x"))


@query(
    "file_matrix",
    "select idx line, " + ", ".join(f"round(asinh(round({t},4)),6)+0.0 as {t}" for t in TRACKS) + " from c_valid",
)
def file_matrix(spark, d):
    path = scratch_path(spark, "matrix")
    rows = rounded(valid_bins(spark, d), *TRACKS, digits=4).orderBy("idx")
    wr.write_tsv(rows, path, TRACKS)
    m = rd.read_matrix(spark, path, asinh=True)
    return m.select("line", *[r(F.col("row")[i]).alias(t) for i, t in enumerate(TRACKS)])


@query(
    "file_network",
    """with e as (select id1, id2 from c_graph), o as (select id1 v, (id1*100000+id2)*2 at0 from e union all select id2, (id1*100000+id2)*2+1 from e),
    f as (select v, row_number() over (order by min(at0))-1 id from o group by v)
    select a.id id1, b.id id2, 1.0::double weight from e join f a on a.v=id1 join f b on b.v=id2""",
)
def file_network(spark, d):
    path = scratch_path(spark, "network")
    ordered = graph(spark, d).orderBy("id1", "id2").select(F.concat_ws(" ", "id1", "id2", "weight").alias("value"))
    ordered.write.text(path)
    lines = rd.read_network(spark, path)
    return numbered_edges(lines, vertex_ids(lines))


@query(
    "file_instances",
    """select label::double as label, count(*)::bigint n, round(sum(x),4)+0.0 total from (
    select label, unnest(embedding)::double x from embeddings) group by label""",
)
def file_instances(spark, d):
    path = scratch_path(spark, "instances")
    wr.write_instances(instances(spark, d), path)
    rows = rd.read_instances(spark, path, 64).select("label", F.explode("value").alias("v"))
    return rounded(rows.groupBy("label").agg(F.count("*").alias("n"), F.sum("v").alias("total")), "total", digits=4)


@query(
    "file_track_folders",
    "select track, chrom, bin start, bin+1 \"end\", round(signal,6)+0.0 as value from c_binned",
)
def file_track_folders(spark, d):
    path = scratch_path(spark, "by-track")
    wr.write_tracks_by_name(rounded(binned(spark, d), "value"), path)
    schema = "chrom string, start bigint, `end` bigint, value double, track string"
    return spark.read.schema(schema).option("sep", "\t").csv(path).select("track", "chrom", "start", "end", "value")


@query(
    "file_posterior",
    "select chrom, pos*500 start, (pos+1)*500 \"end\", round(0.25+(idx%4)*0.125,6)+0.0 p1, round(0.75-(idx%4)*0.125,6)+0.0 p2 from c_nodes",
)
def file_posterior(spark, d):
    path = scratch_path(spark, "posterior")
    n = nodes(spark, d)
    p = 0.25 + (F.col("idx") % 4) * 0.125
    wr.write_posterior(n.select("idx", F.array(p, 1 - p).alias("post")), n, 500, path)
    return rd.tsv(spark, path, "chrom bigint, start bigint, `end` bigint, p1 double, p2 double")
