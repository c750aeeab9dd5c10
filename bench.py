"""Time the headline queries: one JSON line. BENCH_SF_DIR, BENCH_CPUS."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINES = [
    "k_metric_customer",
    "microaggregate_customer",
    "microaggregate_lineitem_dates",
    "kanonymize_mondrian_orders",
    "mask_word_tails_documents",
    "mask_adjacent_part",
    "mask_adjacent_consistently_part",
    "mask_near_numbers_customer",
    "mask_equal_numbers_orders",
    "cover_columns_part",
    "ldiversity_mask_customer",
    "suppress_violations_customer",
    "verify_release_customer",
    "frequency_distances_many_values",
    "laplace_noise_lineitem",
    "shift_dates_orders",
    "secure_sum_lineitem",
    "fit_clients_suppliers",
    "apply_model_lineitem",
    "correlation_matrix_lineitem",
    "top_relationships_lineitem",
    "column_profile_customer",
    "top_values_orders",
    "histogram_quantity",
    "box_summary_lineitem",
    "arrays_to_rows_embeddings",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from queries import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's code paths and the Python workers outside the clock
    spark.read.parquet(f"{sf_dir}/nation.parquet").groupBy("n_regionkey").count().collect()
    spark.range(8).mapInPandas(lambda batches: batches, "id bigint").collect()

    seconds = {}
    for name in HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
