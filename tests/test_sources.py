"""Readers, writers and the entry points on small files."""

import gzip
import json
import struct

import numpy as np
import pytest

from loopweave import workflows
from loopweave.__main__ import parser
from loopweave.sources import binary, readers, writers
from loopweave.sources.graphs import numbered_edges, vertex_ids
from loopweave.streaming.binning import bin_stream


def test_track_reader_skips_comments(spark, tmp_path):
    (tmp_path / "dnase.bedgraph").write_text("# made up\nchr1 0 150 2.0\nchr1\t150\t420\t4.0\n")
    got = readers.read_tracks(spark, str(tmp_path / "*.bedgraph")).collect()
    assert [tuple(r) for r in got] == [("dnase", "chr1", 0, 150, 2.0), ("dnase", "chr1", 150, 420, 4.0)]


def test_annotation_reader(spark, tmp_path):
    path = tmp_path / "a.bed.gz"
    with gzip.open(path, "wt") as f:
        f.write("chrom\tstart\tend\tname\nchr1\t0\t250\tx\t7\nchr9\t5\t6\tNA\t7\n")
    got = readers.read_annotation(spark, str(path), 100, header=True).collect()
    assert [tuple(r) for r in got] == [("chr1", 0, 2, "x"), ("chr9", 0, 0, None)]


def test_bins_are_numbered_in_order(spark, tmp_path):
    (tmp_path / "bins").write_text("chr2\t0\t100\t7\nchr10\t0\t100\t8\nchr2\t300\t400\t9\nchrX\t0\t1\t1\n")
    got = readers.read_bins(spark, str(tmp_path / "bins"), 100, ["chr2", "chr10"]).collect()
    assert sorted((r.idx, r.chrom, r.pos, r.own_index) for r in got) == [
        (0, "chr2", 0, 7), (1, "chr2", 3, 9), (2, "chr10", 0, 8),
    ]


def test_contacts_take_their_pair_from_the_name(spark, tmp_path):
    (tmp_path / "oe_chr1_chr12.txt").write_text("0\t300\t1.5\n100\t100\tNaN\n")
    got = readers.read_contacts(spark, str(tmp_path / "oe_*"), 100).orderBy("pos1").collect()
    assert tuple(got[0]) == (1, 0, 12, 3, 1.5)
    assert np.isnan(got[1].weight)


def test_timing_wigs(spark, tmp_path):
    phases = ["G1", "S1"]
    (tmp_path / "G1.wig").write_text("variableStep chrom=chr1\n0\t60\n1000\t10\nvariableStep chrom=chr2\n0\t99\n")
    (tmp_path / "S1.wig").write_text("variableStep chrom=chr1\n0\t41\nvariableStep chrom=chrX\n0\t100\n")
    got = readers.read_timing_wigs(spark, str(tmp_path), phases).collect()
    assert sorted(map(tuple, got)) == [("chr1", 500, 60, 41), ("chr2", 500, 99, 0)]


def test_embedding_text_and_network(spark, tmp_path):
    vec = spark.createDataFrame([(2, [0.5, -1.0]), (1, [0.25, 2.0])], "idx bigint, vec array<double>")
    writers.write_embedding(vec, str(tmp_path / "emb"))
    lines = [r.value for r in readers.numbered_lines(spark, str(tmp_path / "emb")).orderBy("line").collect()]
    assert lines == ["2 2", "1 0.250000 2.000000 ", "2 0.500000 -1.000000 "]
    assert {r.name: r.vec for r in readers.read_embedding(spark, str(tmp_path / "emb")).collect()} == {
        "1": [0.25, 2.0], "2": [0.5, -1.0],
    }
    (tmp_path / "net").write_text("good the 3\nthe good 3\ngood bad 1\n")
    net = readers.read_network(spark, str(tmp_path / "net"))
    ids = vertex_ids(net)
    assert {r.name: r.id for r in ids.collect()} == {"good": 0, "the": 1, "bad": 2}
    assert sorted(map(tuple, numbered_edges(net, ids).collect())) == [(0, 1, 3.0), (0, 2, 1.0), (1, 0, 3.0)]


def test_sparse_instances_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1.0, [0, 2], [0.5, 2.0]), (-1.0, [1], [3.0])], "label double, index array<int>, value array<double>")
    writers.write_instances(df, str(tmp_path / "x"))
    back = readers.read_instances(spark, str(tmp_path / "x"), 3).orderBy("label").collect()
    assert [(r.label, r["index"], r.value) for r in back] == [(-1.0, [1], [3.0]), (1.0, [0, 2], [0.5, 2.0])]


def test_predictions_and_candidates(spark, tmp_path):
    (tmp_path / "p").write_text("labels 1 2\n2 0.3 0.7\n1 0.9 0.1\n")
    (tmp_path / "c").write_text("2 1 2\n1 2\n")
    got = readers.read_predictions(spark, str(tmp_path / "p")).collect()
    assert sorted(map(tuple, got)) == [(0, "1", 0.3), (0, "2", 0.7), (1, "1", 0.9), (1, "2", 0.1)]
    assert sorted(map(tuple, readers.read_candidates(spark, str(tmp_path / "c")).collect())) == [(0, "1"), (0, "2"), (1, "2")]


def test_binary_formats(spark, tmp_path):
    (tmp_path / "g").write_bytes(struct.pack("<I", 2) + struct.pack("<IHIf", 0, 1, 1, 2.0) + struct.pack("<IHIf", 1, 1, 0, 2.0))
    assert sorted(map(tuple, binary.read_graph(spark, str(tmp_path / "g")).collect())) == [(0, 1, 2.0), (1, 0, 2.0)]
    (tmp_path / "l").write_bytes(struct.pack("<3i", 1, -1, 4))
    assert [r.label for r in binary.read_node_labels(spark, str(tmp_path / "l")).collect()] == [1, -1, 4]
    (tmp_path / "m").write_bytes(struct.pack("<4f", 0.5, 0.5, 0.25, 0.75))
    assert [r.post for r in binary.read_measures(spark, str(tmp_path / "m"), 2).collect()] == [[0.5, 0.5], [0.25, 0.75]]
    (tmp_path / "p").write_bytes(struct.pack("<IH", 1, 2) + struct.pack("<I2f", 7, 0.25, 0.75))
    assert [tuple(r) for r in binary.read_posterior(spark, str(tmp_path / "p")).collect()] == [(7, [0.25, 0.75])]
    (tmp_path / "v").write_bytes(b"2 2\na " + struct.pack("<2f", 1, 2) + b"\nb " + struct.pack("<2f", 3, 4) + b"\n")
    assert [tuple(r) for r in binary.read_vectors(spark, str(tmp_path / "v")).collect()] == [("a", [1.0, 2.0]), ("b", [3.0, 4.0])]
    head = b"HIC\0" + struct.pack("<iq", 8, 99) + b"hg19\0" + struct.pack("<i", 1) + b"k\0v\0" + struct.pack("<i", 2)
    (tmp_path / "h").write_bytes(head + b"All\0" + struct.pack("<i", 5) + b"1\0" + struct.pack("<i", 249))
    assert [tuple(r) for r in binary.read_map_header(spark, str(tmp_path / "h")).collect()] == [(8, "hg19", "chr1", 249)]


def test_graph_with_a_zero_weight_is_refused(spark, tmp_path):
    (tmp_path / "g").write_bytes(struct.pack("<I", 1) + struct.pack("<IHIf", 0, 1, 1, 0.0))
    with pytest.raises(Exception, match="has weight 0"):
        binary.read_graph(spark, str(tmp_path / "g")).collect()


def test_prepare_and_annotate(spark, tmp_path):
    rng = np.random.default_rng(0)
    signals, maps = tmp_path / "signals", tmp_path / "maps"
    signals.mkdir()
    maps.mkdir()
    n, res = 24, 100
    state = [p // 6 % 2 for p in range(n)]
    for name in ("one", "two"):
        rows = [
            f"{c} {p * res} {(p + 1) * res} {4 * state[p] + rng.random():.3f}" for c in ("chr1", "chr2") for p in range(n)
        ]
        (signals / f"{name}.bedgraph").write_text("\n".join(rows) + "\n")
    bins = [f"{c}\t{p * res}\t{(p + 1) * res}\t0" for c in ("chr1", "chr2") for p in range(n)]
    (tmp_path / "bins").write_text("\n".join(bins) + "\n")
    for a, b in ((1, 1), (1, 2), (2, 2)):
        cells = [
            f"{i * res}\t{j * res}\t{(3 if state[i] == state[j] else 1) + rng.random():.3f}"
            for i in range(n) for j in range(i if a == b else 0, n)
        ]
        (maps / f"oe_chr{a}_chr{b}.txt").write_text("\n".join(cells) + "\n")
    out = tmp_path / "out"
    settings = {
        "resolution": res, "num_labels": 2, "valid_chroms": ["chr1", "chr2"], "signals_dir": str(signals),
        "signals_names": ["one", "two"], "valid_bins": str(tmp_path / "bins"), "contacts_dir": str(maps),
        "processed_dir": str(out), "base_count": 40, "embedding_dim": 2, "embedding_samples": 300,
        "max_iter": 3, "cell_type": "x",
    }
    (tmp_path / "config.json").write_text(json.dumps(settings))
    config = readers.read_config(str(tmp_path / "config.json"))
    assert config.more == {"cell_type": "x"}
    made = workflows.prepare(spark, config)
    assert made["features"].count() == 2 * n
    assert made["graph"].count() == 2 * 3 * 40
    segs = workflows.annotate(spark, config)
    found = {(r.chrom, r.start // res): r.label for r in segs.collect()}
    assert found.keys() == {(c, p) for c in ("chr1", "chr2") for p in (0, 6, 12, 18)}
    written = readers.read_annotation(spark, f"{out}/annotations/hmm_k2")
    assert written.count() == segs.count()
    track = readers.read_tracks(spark, str(signals / "one.bedgraph"))
    assert workflows.track_variance_explained(track, segs, res).first().ve > 0.9


def test_streaming_binning_equals_batch(spark, tmp_path):
    from loopweave.operators.tracks import bin_track

    rows = [("chr1", "t", i * 37, i * 37 + 90, float(i % 5)) for i in range(60)]
    ddl = "chrom string, track string, start bigint, end bigint, value double"
    df = spark.createDataFrame(rows, ddl)
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = bin_stream(spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 50)
    q = stream.writeStream.format("memory").queryName("binned").outputMode("complete").start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    got = {(r.pos): round(r.value, 9) for r in spark.table("binned").collect()}
    assert got == {r.pos: round(r.value, 9) for r in bin_track(df, 50, ("track",)).collect()}


def test_command_line():
    args = parser().parse_args(["bias", "-i", "x", "-o", "y", "-r", "100"])
    assert (args.command, args.percent) == ("bias", 0.05)
    assert parser().parse_args(["prepare", "-c", "f"]).config == "f"


def test_fragment_biases(spark):
    dump = spark.createDataFrame(
        [(1, i, 1, j, 1.0 + (i + j) % 4) for i in range(20) for j in range(i, 20)],
        "chrom1 bigint, pos1 bigint, chrom2 bigint, pos2 bigint, weight double",
    )
    got = workflows.fragment_biases(dump, 100).collect()
    assert {r.mid for r in got} == {p * 100 + 50 for p in range(20)}
    assert np.mean([r.bias for r in got if r.bias > 0]) == pytest.approx(1.0)
