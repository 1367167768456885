"""Writers of the text formats. Output is a folder of part files, one per task."""

from __future__ import annotations

from collections.abc import Sequence
from pathlib import Path

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loopweave.operators.linear import SOLVERS, LinearModel
from loopweave.plans.vectors import items


def write_tsv(
    df: DataFrame, path: str, columns: Sequence[str] | None = None, mode: str = "ignore", gzip: bool = False, header: bool = False
) -> None:
    """Tab-separated; an existing folder is left alone unless ``mode`` says otherwise."""
    out = df.select(*columns) if columns else df
    writer = out.write.mode(mode).option("sep", "\t").option("header", header).option("nanValue", "NaN")
    if gzip:
        writer = writer.option("compression", "gzip")
    writer.csv(path)


def write_bins_and_signals(wide: DataFrame, names: Sequence[str], resolution: int, folder: str) -> None:
    """bin/ and signals/ with the bin index in both, so rows need no common order."""
    bins = wide.select(
        "chrom", (F.col("pos") * resolution).alias("start"), ((F.col("pos") + 1) * resolution).alias("end"), "idx"
    )
    write_tsv(bins, f"{folder}/bin")
    write_tsv(wide.select("idx", *names), f"{folder}/signals")


def write_edges(edges: DataFrame, path: str) -> None:
    write_tsv(edges, path, ["id1", "id2", "weight"])


def write_contacts(df: DataFrame, path: str, kind: str, resolution: int, slices: int | None = None) -> None:
    """One folder per chromosome pair, named <kind>_chrA_chrB, of pos1, pos2, weight in bases.

    A pair is spread over ``slices`` tasks (the session's shuffle partitions, if not given) by its
    bins, so a large pair is not one task's.
    """
    slices = slices or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pair = F.concat(F.lit(f"{kind}_chr"), "chrom1", F.lit("_chr"), "chrom2")
    rows = df.select(
        pair.alias("pair"), (F.col("pos1") * resolution).alias("pos1"), (F.col("pos2") * resolution).alias("pos2"), "weight"
    )
    rows.repartition("pair", F.pmod(F.xxhash64("pos1", "pos2"), F.lit(slices))).write.mode("ignore").partitionBy(
        "pair"
    ).option("sep", "\t").csv(path)


def write_annotation(segs: DataFrame, path: str) -> None:
    write_tsv(segs.orderBy("chrom", "start"), path, ["chrom", "start", "end", "label"])


def write_posterior(post: DataFrame, bins: DataFrame, resolution: int, path: str) -> None:
    """chrom, start, end, p1..pK."""
    width = post.agg(F.max(F.size("post"))).first()[0]
    placed = post.join(bins.select("idx", "chrom", "pos"), "idx")
    write_tsv(
        placed.select(
            "chrom",
            (F.col("pos") * resolution).alias("start"),
            ((F.col("pos") + 1) * resolution).alias("end"),
            *[v.alias(f"p{i + 1}") for i, v in enumerate(items("post", width))],
        ),
        path,
    )


def write_tracks_by_name(binned: DataFrame, path: str) -> None:
    """One folder per track in bin coordinates: chrom, start, end, value."""
    rows = binned.select("track", "chrom", F.col("pos").alias("start"), (F.col("pos") + 1).alias("end"), "value")
    rows.write.mode("ignore").partitionBy("track").option("sep", "\t").csv(path)


def write_bias(bias: DataFrame, fragments: DataFrame, path: str) -> None:
    """chrom, mid, bias, gzipped; ``fragments(idx, chrom, mid)``."""
    write_tsv(bias.join(fragments, "idx"), path, ["chrom", "mid", "bias"], gzip=True)


def write_fragment_files(contacts: DataFrame, fragments: DataFrame, resolution: int, folder: str) -> None:
    """interactions/ (both midpoints and weight) and fragments/ (marginals), gzipped."""
    half = resolution // 2
    write_tsv(
        contacts.select(
            "chrom1", (F.col("pos1") * resolution + half).alias("mid1"),
            "chrom2", (F.col("pos2") * resolution + half).alias("mid2"), "weight",
        ),
        f"{folder}/interactions", gzip=True,
    )
    write_tsv(fragments.orderBy("chrom", "mid"), f"{folder}/fragments", ["chrom", "extra", "mid", "weight", "mappable"], gzip=True)


def write_embedding(vectors: DataFrame, path: str) -> None:
    """Header ``N dim``, then ``id v1 ... vd``; parts are in id order, the header comes first."""
    size = vectors.agg(F.count("*").alias("n"), F.max(F.size("vec")).alias("d"))
    head = size.select(F.lit(None).cast("bigint").alias("idx"), F.concat_ws(" ", "n", "d").alias("value"))
    body = vectors.select(
        F.col("idx").cast("bigint").alias("idx"),
        F.concat(
            F.col("idx").cast("string"), F.lit(" "),
            F.array_join(F.transform("vec", lambda x: F.format_string("%.6f", x)), " "), F.lit(" "),
        ).alias("value"),
    )
    head.unionByName(body).orderBy(F.col("idx").asc_nulls_first()).select("value").write.mode("ignore").text(path)


def write_instances(rows: DataFrame, path: str) -> None:
    """``label i:v ...`` with 1-based indices."""
    pairs = F.transform(
        F.arrays_zip("index", "value"),
        lambda e: F.concat_ws(":", (e["index"] + 1).cast("string"), e["value"].cast("string")),
    )
    label = F.regexp_replace(F.col("label").cast("string"), r"\.0$", "")
    rows.select(F.concat_ws(" ", label, F.array_join(pairs, " ")).alias("value")).write.mode("ignore").text(path)


def save_model(model: LinearModel, path: str) -> None:
    """The text form of a linear model; its size is features x classes."""
    name = SOLVERS[model.solver][0]
    lines = [f"solver_type {name}", f"nr_class {len(model.labels) or 2}"]
    if model.labels:
        lines.append("label " + " ".join(f"{v:g}" for v in model.labels))
    lines += [f"nr_feature {model.features}", f"bias {model.bias:.16g}", "w"]
    lines += [" ".join(f"{v:.16g}" for v in row) + " " for row in model.weights.T]
    Path(path).write_text("\n".join(lines) + "\n")


def load_model(path: str) -> LinearModel:
    head, _, body = Path(path).read_text().partition("\nw\n")
    keys = dict(line.split(" ", 1) for line in head.splitlines())
    number = next(k for k, v in SOLVERS.items() if v[0] == keys["solver_type"])
    weights = np.array([[float(x) for x in line.split()] for line in body.splitlines() if line.strip()])
    labels = [float(v) for v in keys["label"].split()] if "label" in keys else []
    return LinearModel(number, labels, weights.T, int(keys["nr_feature"]), float(keys["bias"]))
