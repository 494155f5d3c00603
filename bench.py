"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the
cores. Each query is written to Spark's noop sink, so what is timed is the whole
result without its way to the driver. Each query runs twice and the second run counts,
as the first one also starts workers and compiles.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

ROOT = str(Path(__file__).resolve().parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, os.environ.get("PYTHONPATH")) if x)

from pyspark.sql import SparkSession  # noqa: E402

from batchlake.plans import catalog  # noqa: E402

HEADLINE = [
    "message_training_set", "bigram_model", "vocab_oov_last", "pad_left_encode", "fold_next_target", "seq_batches_wrap", "random_batches", "permute_rows",
    "class_balanced_draw", "pack_single_column", "channel_stats", "rescale_values", "ten_crop", "tweet_tokens", "range_rows",
]


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}
    for name in HEADLINE:
        for _ in range(2):
            t = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - t, 3)
    stats = catalog.corpus_statistics(spark, sf_dir).first()
    first = took["message_training_set"]
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": Path(sf_dir).name, "cpus": int(cpus),
        "training_set_rows_per_s": round(stats.n_messages / first), "training_set_tokens_per_s": round(stats.n_tokens / first),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
