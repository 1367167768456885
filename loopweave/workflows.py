"""The entry points: prepare tables, label bins, score an annotation, balance a map."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopweave.operators import annotation as an
from loopweave.operators import balance, contacts, embed, evaluation, hmm, mixture, mrf, report, resample, tracks
from loopweave.session import materialize
from loopweave.sources import readers, writers


def prepare(spark: SparkSession, config: readers.Config) -> dict[str, DataFrame]:
    """Bin the tracks, join them on the valid bins and pick the interaction graph.

    Writes bin/, signals/ and interactions/ below ``processed_dir``; existing ones stay.
    """
    bins = readers.read_bins(spark, config.valid_bins, config.resolution, config.valid_chroms)
    raw = readers.read_tracks(spark, f"{config.signals_dir}/*.bedgraph")
    binned = tracks.bin_track(raw.filter(F.col("track").isin(config.signals_names)), config.resolution, keys=("track",))
    wide = tracks.track_matrix(binned, config.signals_names)
    features = bins.select("chrom", "pos", "idx").join(wide, ["chrom", "pos"])
    writers.write_bins_and_signals(features, config.signals_names, config.resolution, config.processed_dir)
    numbered = bins.select(an.chrom_number(F.col("chrom")).cast("bigint").alias("chrom"), "pos", "idx")
    dump = readers.read_contacts(spark, f"{config.contacts_dir}/oe_chr*", config.resolution)
    graph = contacts.quota_graph(dump, numbered, config.base_count)
    writers.write_edges(graph, f"{config.processed_dir}/interactions")
    return {"bins": bins, "features": features, "graph": graph}


def chained(features: DataFrame, block: int = 1 << 16) -> DataFrame:
    """Adds chain (the first index of the run of consecutive bins), n (its length) and t (offset).

    Bins of a run are numbered without gaps, so a run is found by index as well as by position.
    """
    runs = an.chunks(features.select("chrom", "pos"), block).join(
        features.select("chrom", F.col("pos").alias("start"), F.col("idx").alias("chain")), ["chrom", "start"]
    )
    members = F.explode(F.sequence(F.col("chain"), F.col("chain") + F.col("n") - 1))
    pieces = runs.select("chain", "n", members.alias("idx"))
    return features.join(pieces, "idx").withColumn("t", F.col("idx") - F.col("chain"))


def label_bins(
    features: DataFrame, k: int, max_iter: int = 10, seed: int = 1, resolution: int = 1
) -> DataFrame:
    """Segments chrom, start, end, label of the hidden Markov labelling.

    ``features(idx, chrom, pos, features)``; idx numbers the bins in order.
    """
    features = materialize(features.select("idx", "chrom", "pos", "features"))
    chains = chained(features)
    blocks = hmm.pack_chains(chains.select("chain", "n", "t", "idx", "features"))
    params, _ = hmm.fit_hmm(blocks, hmm.initial_params(features, k, seed), max_iter)
    labels = features.select("idx", "chrom", "pos").join(hmm.decode(blocks, params), "idx")
    return an.segments(labels.select("chrom", "pos", "label"), resolution)


def combined_features(wide: DataFrame, names: Sequence[str], vectors: DataFrame) -> DataFrame:
    """asinh signals with the node embedding appended, joined by index."""
    signals = tracks.feature_arrays(
        wide.select("idx", "chrom", "pos", *[F.asinh(n).alias(n) for n in names]), names, ["idx", "chrom", "pos"]
    )
    return tracks.append_vectors(signals, vectors.withColumnRenamed("vec", "features"))


def annotate(spark: SparkSession, config: readers.Config) -> DataFrame:
    """Embed the interaction graph, label the bins and write the annotation."""
    folder = config.processed_dir
    bins = readers.read_bins(spark, f"{folder}/bin", config.resolution, config.valid_chroms)
    columns = ", ".join(f"`{n}` double" for n in config.signals_names)
    signals = readers.tsv(spark, f"{folder}/signals", f"idx bigint, {columns}")
    edges = readers.tsv(spark, f"{folder}/interactions", "id1 bigint, id2 bigint, weight double")
    params = embed.EmbedParams(dim=config.embedding_dim, samples=config.embedding_samples, seed=config.seed)
    vectors = embed.embed(edges, params)
    writers.write_embedding(vectors, f"{folder}/embeddings")
    own = bins.select("chrom", "pos", F.col("own_index").alias("idx"))
    wide = own.join(signals, "idx")
    segs = label_bins(
        combined_features(wide, config.signals_names, vectors), config.num_labels, config.max_iter,
        config.seed, config.resolution,
    )
    writers.write_annotation(segs, f"{folder}/annotations/hmm_k{config.num_labels}")
    return segs


def evaluate(
    segs: DataFrame,
    genes: DataFrame,
    timing: DataFrame,
    paired: Mapping[str, DataFrame],
    resolution: int,
    phases: Sequence[str],
) -> DataFrame:
    """One row of scores of an annotation."""
    labels = an.labels_from_segments(segs, resolution)
    return report.stats(segs, labels, genes, timing, resolution, phases, paired)


def evaluate_resampled(
    segs: DataFrame,
    genes: DataFrame,
    timing: DataFrame,
    paired: Mapping[str, DataFrame],
    resolution: int,
    phases: Sequence[str],
    reps: int = 20,
) -> DataFrame:
    """The same scores on ``reps`` resamples; ``paired`` holds binned pairs."""
    labels = materialize(an.labels_from_segments(segs, resolution))
    expressed = evaluation.gene_labels(genes, labels, resolution).withColumn("signal", F.asinh("expr"))
    by_bin = evaluation.timing_by_bin(timing, labels, resolution, phases)
    scores = {
        "ge_ve": resample.bootstrap_variance_explained(expressed, ["gene_id"], ["signal"], reps),
        "rt_ve": resample.bootstrap_variance_explained(by_bin, ["chrom", "bin"], phases, reps),
    }
    shares = evaluation.coverage(segs)
    for name, pairs in paired.items():
        labelled = evaluation.binned_pair_labels(pairs, labels)
        scores[name] = resample.bootstrap_over_expected(
            labelled, shares, ["chrom1", "pos1", "chrom2", "pos2"], reps
        )
    return resample.bootstrap_stats(scores)


def track_variance_explained(
    track: DataFrame, segs: DataFrame, resolution: int, binned: bool = False
) -> DataFrame:
    """Variance of one track explained by an annotation; the track is binned first if need be."""
    values = track if binned else tracks.bin_track(track, resolution)
    joined = an.melt(segs, resolution).join(values, ["chrom", "pos"])
    return evaluation.variance_explained(joined.withColumnRenamed("value", "signal"))


def fragment_biases(dump: DataFrame, resolution: int, fraction: float = 0.05) -> DataFrame:
    """chrom, mid, bias of the contact map ``dump(chrom1, pos1, chrom2, pos2, weight)``."""
    fragments = materialize(
        contacts.index_bins(
            contacts.fragment_marginals(dump, resolution).withColumn(
                "pos", F.expr(f"(mid - {resolution // 2}) div {resolution}")
            )
        ).select("chrom", "pos", "mid", "idx")
    )
    bias = balance.bias_vector(contacts.indexed_contacts(dump, fragments), fraction)
    return bias.join(fragments, "idx").select("chrom", "mid", "bias")


def random_field(features: DataFrame, edges: DataFrame, k: int = 10, **options) -> DataFrame:
    return mrf.fit_random_field(features, edges, k, **options)


def mixture_labels(features: DataFrame, edges: DataFrame, k: int, loops: int = 5, rounds: int = 5, weight: float = 1.0) -> DataFrame:
    """idx, post, label of the mixture that takes propagated posteriors as evidence.

    Edge weights are ignored and every edge counts in both directions.
    """
    unit = contacts.swap_union(edges.select("id1", "id2")).withColumn("weight", F.lit(1.0))
    return mixture.mixture_with_propagation(features, unit, k, loops, rounds, weight)
