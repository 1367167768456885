"""Readers of the text formats. Every schema is explicit; files split as Spark splits them."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.functions.scalar import is_autosome
from loopweave.operators.annotation import chrom_number
from loopweave.plans.scan import carry_forward, dense_index


def tsv(spark: SparkSession, path: str, ddl: str, header: bool = False, comment: str | None = None) -> DataFrame:
    reader = spark.read.schema(ddl).option("sep", "\t").option("header", header).option("nanValue", "NaN")
    if comment:
        reader = reader.option("comment", comment)
    return reader.csv(path)


def read_chrom_sizes(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "chrom string, size bigint")


def read_arm_sizes(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "chrom string, arm string, size bigint")


@dataclass
class Config:
    """Settings of the entry points; keys of the JSON file that are not listed go to ``more``."""

    resolution: int = 100_000
    num_labels: int = 8
    chr_size_path: str = ""
    valid_chroms: list[str] = field(default_factory=lambda: [f"chr{i}" for i in range(1, 23)])
    signals_dir: str = ""
    signals_names: list[str] = field(default_factory=list)
    valid_bins: str = ""
    contacts_dir: str = ""
    processed_dir: str = ""
    base_count: int = 2000
    embedding_dim: int = 8
    embedding_samples: int = 1_000_000
    max_iter: int = 10
    seed: int = 1
    more: dict = field(default_factory=dict)


def read_config(path: str) -> Config:
    raw = json.loads(Path(path).read_text())
    known = {k: v for k, v in raw.items() if k in Config.__dataclass_fields__ and k != "more"}
    return Config(**known, more={k: v for k, v in raw.items() if k not in known})


def read_gene_info(spark: SparkSession, path: str) -> DataFrame:
    """The first six columns; further ones are ignored."""
    return tsv(spark, path, "gene_id string, chr string, start bigint, end bigint, strand string, type string")


def read_expression_table(spark: SparkSession, path: str) -> DataFrame:
    """Columns named by the header row; values stay strings."""
    return spark.read.option("sep", "\t").option("header", True).csv(path)


def read_gene_expression(spark: SparkSession, path: str) -> DataFrame:
    """gene_id, chrom, start, end, expr; chromosome numbers 1..22 only, ends in either order."""
    raw = tsv(spark, path, "gene_id string, chr string, pos1 bigint, pos2 bigint, x string, expr double")
    return raw.filter(F.col("chr").rlike("^([1-9]|1[0-9]|2[0-2])$")).select(
        "gene_id",
        F.concat(F.lit("chr"), "chr").alias("chrom"),
        F.least("pos1", "pos2").alias("start"),
        F.greatest("pos1", "pos2").alias("end"),
        "expr",
    )


def read_annotation(
    spark: SparkSession,
    path: str,
    resolution: int | None = None,
    header: bool = False,
    chroms: Sequence[str] | None = None,
) -> DataFrame:
    """chrom, start, end, label; ``resolution`` turns bases into bins; gz files read alike."""
    df = tsv(spark, path, "chrom string, start bigint, end bigint, label string", header=header)
    if resolution:
        df = df.withColumn("start", F.expr(f"start div {resolution}")).withColumn(
            "end", F.expr(f"`end` div {resolution}")
        )
    df = df.withColumn("label", F.when(F.col("label") != "NA", F.col("label")))
    return df.filter(F.col("chrom").isin(list(chroms))) if chroms else df


def read_bins(spark: SparkSession, path: str, resolution: int, chroms: Sequence[str] | None = None) -> DataFrame:
    """chrom, start, end, pos, own_index (the file's), idx (row order of the sorted file)."""
    df = tsv(spark, path, "chrom string, start bigint, end bigint, own_index bigint")
    if chroms:
        df = df.filter(F.col("chrom").isin(list(chroms)))
    df = df.withColumn("pos", F.expr(f"start div {resolution}")).withColumn("_rank", chrom_number(F.col("chrom")))
    return dense_index(df, ["_rank", "start"]).drop("_rank")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """line (0-based, in file order over the sorted file paths), value, file."""
    raw = spark.read.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file"),
        F.col("_metadata.file_path").alias("_path"),
        F.col("_metadata.file_block_start").alias("_at"),
        F.monotonically_increasing_id().alias("_m"),
    )
    return dense_index(raw, ["_path", "_at", "_m"], "line").drop("_path", "_at", "_m")


def _fields(col: str = "value") -> Column:
    return F.split(F.trim(col), r"\s+")


def _rest(fields: Column | str) -> Column:
    """All fields but the first."""
    fields = F.col(fields) if isinstance(fields, str) else fields
    return F.slice(fields, F.lit(2), F.greatest(F.size(fields) - 1, F.lit(0)))


def source_name() -> Column:
    """Name of the file a row comes from, or of its folder where that is a written dataset."""
    name = F.col("_metadata.file_name")
    folder = F.element_at(F.split("_metadata.file_path", "/"), -2)
    return F.when(name.startswith("part-"), F.element_at(F.split(folder, "="), -1)).otherwise(name)


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """track (file name), chrom, start, end, value; blank-separated, # lines are comments."""
    f = F.col("f")
    return (
        spark.read.text(path)
        .filter(~F.col("value").startswith("#") & (F.trim("value") != ""))
        .select(F.regexp_extract(source_name(), r"^(.*?)(\.bedgraph)?$", 1).alias("track"), _fields().alias("f"))
        .select(
            "track",
            f[0].alias("chrom"),
            f[1].cast("bigint").alias("start"),
            f[2].cast("bigint").alias("end"),
            f[3].cast("double").alias("value"),
        )
    )


def read_contacts(spark: SparkSession, path: str, resolution: int = 1) -> DataFrame:
    """chrom1, pos1, chrom2, pos2, weight of files named <kind>_chrA_chrB.txt; bins."""
    name = source_name()
    raw = tsv(spark, path, "pos1 bigint, pos2 bigint, weight double")
    return raw.select(
        F.regexp_extract(name, r"_chr([0-9]+)_chr[0-9]+", 1).cast("bigint").alias("chrom1"),
        F.expr(f"pos1 div {resolution}").alias("pos1"),
        F.regexp_extract(name, r"_chr[0-9]+_chr([0-9]+)", 1).cast("bigint").alias("chrom2"),
        F.expr(f"pos2 div {resolution}").alias("pos2"),
        "weight",
    )


def read_significance(spark: SparkSession, path: str, resolution: int) -> DataFrame:
    """chrom1, pos1, chrom2, pos2, pvalue of significance files with a header row."""
    raw = tsv(
        spark, path, "chr1 string, mid1 bigint, chr2 string, mid2 bigint, count bigint, pvalue double", header=True
    )
    return raw.select(
        F.col("chr1").alias("chrom1"),
        F.expr(f"mid1 div {resolution}").alias("pos1"),
        F.col("chr2").alias("chrom2"),
        F.expr(f"mid2 div {resolution}").alias("pos2"),
        "pvalue",
    )


def read_paired_regions(spark: SparkSession, path: str) -> DataFrame:
    ddl = (
        "chrom1 string, start1 bigint, end1 bigint, chrom2 string, start2 bigint, end2 bigint, weight bigint"
    )
    return tsv(spark, path, ddl, comment="#")


def read_binned_pairs(spark: SparkSession, path: str) -> DataFrame:
    return tsv(spark, path, "chrom1 string, pos1 bigint, chrom2 string, pos2 bigint, weight double", header=True)


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    """region_id (line number without the header), chrom, start, end; chromosomes carry no prefix in the file."""
    f = F.split("value", "\t")
    rows = numbered_lines(spark, path).filter("line > 0")
    return rows.select(
        F.concat(F.lit("chr"), f[0]).alias("chrom"),
        f[1].cast("bigint").alias("start"),
        f[2].cast("bigint").alias("end"),
        (F.col("line") - 1).alias("region_id"),
    )


def read_embedding(spark: SparkSession, path: str) -> DataFrame:
    """name, vec of a text embedding, as one file or a written folder; line 0 is the header."""
    return (
        numbered_lines(spark, path)
        .filter("line > 0")
        .select(_fields().alias("f"))
        .select(F.col("f")[0].alias("name"), F.transform(_rest("f"), lambda x: x.cast("double")).alias("vec"))
    )


def read_matrix(spark: SparkSession, path: str, sep: str = "\t", skip: int = 0, asinh: bool = False) -> DataFrame:
    """line, row array<double> of a delimited matrix; ``skip`` leading lines are dropped."""
    def cell(x: Column) -> Column:
        value = x.cast("double")
        return F.asinh(value) if asinh else value

    lines = numbered_lines(spark, path).filter(F.col("line") >= skip)
    return lines.select((F.col("line") - skip).alias("line"), F.transform(F.split("value", sep), cell).alias("row"))


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """line, chrom, start, end of a blank-separated window file."""
    f = F.col("f")
    return numbered_lines(spark, path).select("line", _fields().alias("f")).select(
        "line", f[0].alias("chrom"), f[1].cast("bigint").alias("start"), f[2].cast("bigint").alias("end")
    )


def read_network(spark: SparkSession, path: str) -> DataFrame:
    """line, u, v, weight of a blank-separated edge list; names are kept in full."""
    f = F.col("f")
    return numbered_lines(spark, path).select("line", _fields().alias("f")).select(
        "line", f[0].alias("u"), f[1].alias("v"), f[2].cast("double").alias("weight")
    )


def read_timing_wig_lines(spark: SparkSession, path: str, phase: str) -> DataFrame:
    """phase, chrom, bin (1 kb), value, line of one phase.

    A ``variableStep chrom=...`` line names the chromosome of the rows after it.
    """
    lines = numbered_lines(spark, path).select(
        "line", F.split("value", "\t").alias("f"), F.regexp_extract("value", r"chrom=(\S+)", 1).alias("_c")
    )
    named = carry_forward(
        lines.withColumn("chrom", F.when(F.size("f") < 2, F.col("_c"))).withColumn("phase", F.lit(phase)),
        ["phase"], "line", "chrom",
    )
    return named.filter(F.size("f") == 2).select(
        "phase", "chrom", F.expr("cast(f[0] as bigint) div 1000").alias("bin"),
        F.col("f")[1].cast("bigint").alias("value"), "line",
    )


def timing_table(rows: DataFrame, phases: Sequence[str], tolerance: float = 2.0) -> DataFrame:
    """chrom, pos (middle of the bin) and one column per phase.

    A phase without a row for the bin is 0, a bin named twice keeps the later row, and bins
    whose phases add up to 100 within ``tolerance`` are kept.
    """
    cells = [
        F.coalesce(
            F.max_by("value", F.when(F.col("phase") == p, F.col("line"))), F.lit(0).cast("bigint")
        ).alias(p)
        for p in phases
    ]
    wide = rows.filter(is_autosome(F.col("chrom"))).groupBy("chrom", "bin").agg(*cells)
    whole = sum((F.col(p) for p in phases[1:]), F.col(phases[0]))
    return wide.filter(F.abs(whole - 100) <= tolerance).select(
        "chrom", (F.col("bin") * 1000 + 500).alias("pos"), *phases
    )


def read_timing_wigs(spark: SparkSession, folder: str, phases: Sequence[str], tolerance: float = 2.0) -> DataFrame:
    """``timing_table`` of the files <phase>.wig in a folder."""
    rows = None
    for p in phases:
        one = read_timing_wig_lines(spark, f"{folder}/{p}.wig", p)
        rows = one if rows is None else rows.unionByName(one)
    return timing_table(rows, phases, tolerance)


def read_timing(spark: SparkSession, path: str, phases: Sequence[str]) -> DataFrame:
    return tsv(spark, path, "chrom string, pos bigint, " + ", ".join(f"{p} double" for p in phases))


def read_instances(spark: SparkSession, path: str, features: int | None = None, bias: float = -1.0) -> DataFrame:
    """label, index (0-based), value of sparse instances ``label i:v ...``; zeros are left out.

    Indices have to ascend from 1, within ``features`` if that is given; a bad line fails the read
    with its number. ``bias`` >= 0 adds a feature of that value behind the last one.
    """
    lines = numbered_lines(spark, path).filter(F.trim("value") != "").select("line", _fields().alias("f"))
    pairs = F.transform(_rest("f"), lambda x: F.split(x, ":"))
    rows = lines.select(
        "line",
        F.col("f")[0].try_cast("double").alias("label"),
        F.transform(pairs, lambda p: F.struct((p[0].try_cast("int") - 1).alias("i"), F.try_element_at(p, F.lit(2)).try_cast("double").alias("v"))).alias("p"),
    )
    index = F.transform("p", lambda s: s["i"])
    whole = F.forall("p", lambda s: s["i"].isNotNull() & s["v"].isNotNull() & (s["i"] >= 0))
    within = F.lit(True) if features is None else F.forall("p", lambda s: s["i"] < features)
    good = F.col("label").isNotNull() & whole & within & (F.array_sort(F.array_distinct(index)) == index)
    fault = F.raise_error(F.concat(F.lit("wrong input in line "), (F.col("line") + 1).cast("string")))
    rows = rows.withColumn("p", F.when(good, F.col("p")).otherwise(fault))
    if bias >= 0:
        width = features if features is not None else rows.agg(F.max(F.element_at(F.concat(F.array(F.lit(-1)), index), -1)) + 1).first()[0]
        extra = F.struct(F.lit(width).cast("int").alias("i"), F.lit(float(bias)).alias("v"))
        rows = rows.withColumn("p", F.concat("p", F.array(extra)))
    kept = F.filter("p", lambda s: s["v"] != 0)
    return rows.select(
        "label", F.transform(kept, lambda s: s["i"]).alias("index"), F.transform(kept, lambda s: s["v"]).alias("value")
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """row, label, score: the header names the labels of the columns after the prediction."""
    lines = numbered_lines(spark, path).select("line", _fields().alias("f"))
    head = lines.filter("line = 0").select(_rest("f")).scalar()
    return (
        lines.filter("line > 0")
        .select((F.col("line") - 1).alias("row"), F.explode(F.arrays_zip(head.alias("label"), _rest("f").alias("score"))).alias("e"))
        .select("row", F.col("e.label").alias("label"), F.col("e.score").cast("double").alias("score"))
    )


def read_candidates(spark: SparkSession, path: str) -> DataFrame:
    """row, label: ``n l1 ... ln`` per row."""
    return numbered_lines(spark, path).select(
        F.col("line").alias("row"), F.explode(_rest(_fields())).alias("label")
    )
