"""Time the headline queries on one data folder and print one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

HEADLINE = [
    "merge_flags", "merge_chain", "first_match", "merged_cells", "feature_table",
    "widen", "tidy", "split_by_probe", "null_prune", "low_variance",
    "zscore_by_group", "median_normalise", "ci_quantiles", "spearman",
    "ridge_fit", "confusion_report", "bootstrap_median", "stratified_split", "knn_manhattan",
    "quantile_contrast", "hist_contrast", "shape_features", "cell_crop", "class_fractions",
    "probe_by_class", "components", "nearest_distance", "wide_distance", "probe_localisation",
    "cooccurrence_corr", "plot_dataset",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    import catalog
    from cytoframe.session import build_session

    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    catalog.load()
    # one untimed query starts the engine and the Python workers
    catalog.QUERIES["nearest_distance"](spark, sf_dir).limit(1).collect()
    times = {}
    for name in only or HEADLINE:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
                "shuffle_partitions": int(cpus),
                "spark": spark.version,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
