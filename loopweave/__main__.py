"""Command line: ``python -m loopweave COMMAND ...``; ``--help`` lists the commands."""

from __future__ import annotations

import argparse

from pyspark.sql import functions as F

from loopweave import workflows
from loopweave.operators import embed, linear
from loopweave.operators.graph import densify
from loopweave.session import build_session
from loopweave.sources import graphs, readers, writers


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="loopweave")
    sub = top.add_subparsers(dest="command", required=True)
    for name, text in (
        ("prepare", "bin tracks, join them and pick the interaction graph"),
        ("annotate", "embed the graph, label the bins, write the annotation"),
    ):
        p = sub.add_parser(name, help=text)
        p.add_argument("-c", "--config", required=True, help="JSON settings")
    p = sub.add_parser("bias", help="balance a contact map")
    p.add_argument("-i", "--interactions", required=True)
    p.add_argument("-o", "--output", required=True)
    p.add_argument("-r", "--resolution", type=int, required=True)
    p.add_argument("-x", "--percent", type=float, default=0.05, help="share of sparsest bins to leave out")
    p = sub.add_parser("evaluate", help="score an annotation")
    p.add_argument("-a", "--annotation", required=True)
    p.add_argument("-g", "--genes", required=True, help="gene expression table")
    p.add_argument("-t", "--timing", required=True, help="replication timing table")
    p.add_argument("-p", "--pairs", nargs="*", default=[], metavar="NAME=PATH", help="paired regions")
    p.add_argument("-r", "--resolution", type=int, required=True)
    p.add_argument("--phases", nargs="+", default=["G1", "S1", "S2", "S3", "S4", "G2"])
    p.add_argument("-o", "--output", required=True)
    p = sub.add_parser("embed", help="embed a network (u v weight)")
    _files(p)
    p.add_argument("--dim", type=int, default=100)
    p.add_argument("--order", type=int, default=2, choices=(1, 2))
    p.add_argument("--negative", type=int, default=5)
    p.add_argument("--samples", type=int, default=1_000_000)
    p.add_argument("--rho", type=float, default=0.025)
    p = sub.add_parser("densify", help="add the strongest indirect neighbours of small vertices")
    _files(p)
    p.add_argument("-k", "--neighbours", type=int, default=1000)
    p.add_argument("-d", "--depth", type=int, default=2)
    p = sub.add_parser("normalise", help="scale vectors to length 1")
    _files(p)
    p = sub.add_parser("concatenate", help="normalise two embeddings and append the second")
    _files(p)
    p.add_argument("-j", "--second", required=True)
    p = sub.add_parser("train", help="fit a linear model to sparse instances")
    _files(p)
    p.add_argument("-s", "--solver", type=int, default=1)
    p.add_argument("-c", "--cost", type=float, default=1.0)
    p.add_argument("-e", "--eps", type=float, default=0.01)
    p.add_argument("-B", "--bias", type=float, default=-1.0)
    p.add_argument("-n", "--features", type=int, required=True)
    p = sub.add_parser("predict", help="label sparse instances with a saved model")
    _files(p)
    p.add_argument("-m", "--model", required=True)
    return top


def _files(p: argparse.ArgumentParser) -> None:
    p.add_argument("-i", "--input", required=True)
    p.add_argument("-o", "--output", required=True)


def _toolkit(spark, args) -> None:
    if args.command in ("embed", "densify"):
        named = readers.read_network(spark, args.input)
        ids = graphs.vertex_ids(named)
        edges = graphs.numbered_edges(named, ids)
        if args.command == "embed":
            p = embed.EmbedParams(args.dim, args.order, args.negative, args.samples, args.rho)
            writers.write_embedding(embed.embed(edges, p), args.output)
        else:
            writers.write_edges(densify(edges, args.neighbours, args.depth), args.output)
        writers.write_tsv(ids, f"{args.output}.names")
    elif args.command in ("normalise", "concatenate"):
        def vectors(path):
            return readers.read_embedding(spark, path).select(F.col("name").cast("bigint").alias("idx"), "vec")

        done = embed.normalise(vectors(args.input))
        if args.command == "concatenate":
            done = embed.concatenate(vectors(args.input), vectors(args.second))
        writers.write_embedding(done, args.output)
    elif args.command == "train":
        p = linear.LinearParams(args.solver, args.cost, args.eps, bias=args.bias)
        data = readers.read_instances(spark, args.input, args.features, args.bias)
        writers.save_model(linear.train(data, p, args.features), args.output)
    else:
        model = writers.load_model(args.model)
        data = readers.read_instances(spark, args.input, None, -1.0)
        if model.bias >= 0:
            data = readers.read_instances(spark, args.input, model.features, model.bias)
        writers.write_tsv(linear.predict(data, model).select("label", "prediction"), args.output)


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    spark = build_session()
    if args.command == "prepare":
        workflows.prepare(spark, readers.read_config(args.config))
    elif args.command == "annotate":
        workflows.annotate(spark, readers.read_config(args.config))
    elif args.command == "evaluate":
        pairs = dict(pair.split("=", 1) for pair in args.pairs)
        found = workflows.evaluate(
            readers.read_annotation(spark, args.annotation, args.resolution),
            readers.read_gene_expression(spark, args.genes),
            readers.read_timing(spark, args.timing, args.phases),
            {name: readers.read_paired_regions(spark, path) for name, path in pairs.items()},
            args.resolution,
            args.phases,
        )
        found.write.mode("ignore").json(args.output)
    elif args.command != "bias":
        _toolkit(spark, args)
    else:
        dump = readers.read_contacts(spark, args.interactions, args.resolution)
        bias = workflows.fragment_biases(dump, args.resolution, args.percent)
        writers.write_tsv(bias, args.output, gzip=True)


if __name__ == "__main__":
    main()
