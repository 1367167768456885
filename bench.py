"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from loopweave.catalog import QUERIES
from loopweave.session import build_session, clear_scratch

HEADLINE = [
    "track_binning", "feature_matrix", "annotation_segments", "chunk_lengths", "closest_valid_bins",
    "contact_index", "strongest_contacts", "quota_graph", "fragment_marginals", "region_labels",
    "region_agreement", "variance_explained", "paired_region_table", "overlap_counts", "morans_i",
    "bootstrap_expression_ve", "balance_fixed_point", "measure_propagation", "loopy_beliefs",
    "multilabel_f1", "balance_newton", "bootstrap_stats", "markov_path", "graph_embedding", "logistic_classes",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"),
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    clear_scratch(spark)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )


if __name__ == "__main__":
    main()
