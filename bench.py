"""Time the headline queries and print one JSON line.

Each query runs to completion into Spark's no-op sink. ``BENCH_SF_DIR`` names
the data, ``BENCH_CPUS`` the cores.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

HEADLINE = (
    "t1_missing_percent",
    "t8_race_consolidation",
    "i1_occupancy_by_property",
    "i6_income_by_geography",
    "i8_random_fill",
    "i12_cleaning_plan",
    "f1_loan_amount_log",
    "f7_target_mean_encoding",
    "f14_bulk_encoding",
    "f16_feature_plan",
    "m1_stratified_split",
    "m2_stratified_folds",
    "m13_stream_decision",
    "v3_class_report",
    "v4_auc",
    "v6_mean_roc",
    "e7_histogram_lineitem",
    "e8_describe_lineitem",
    "e9_rate_by_category",
    "e11_decile_lineitem",
    "e15_correlation_lineitem",
    "r1_word_chunks",
    "r6_top_k_l2",
    "s5_chunk_upsert",
)
# Timed too, but not part of the total, which stays comparable from round to round.
FURTHER = (
    "m3_network_training",
    "m9_fold_encodings",
    "m10_batch_score",
    "r3_text_embedding",
    "r6_cells_compared",
    "r6_approximate_join",
    "r9_explained_heads",
    "s7_model_round_trip",
)


def main() -> None:
    from fitgrain.catalog import QUERIES
    from fitgrain.session import local_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and compile what every query uses.
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or (*HEADLINE, *FURTHER):
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(t for name, t in times.items() if sys.argv[1:] or name in HEADLINE), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
