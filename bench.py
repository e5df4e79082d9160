"""Times the headline queries and prints one JSON line.

The chain tables are derived and stored first, as a chain would be; that time is
reported apart. Every query then runs to the end of all its rows, twice, and the
second run counts; the first is reported as ``cold``.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from eventloom import fixtures
from eventloom.functions.bloom import mapping_gate
from eventloom.queries import PAIR, QUERIES
from eventloom.session import scratch_path

HEADER_COPIES = 400
HEADLINES = [
    "decode_transfers",
    "sync_transfers",
    "multi_mapping",
    "decode_wide",
    "decode_int",
    "native_transfers",
    "candidate_blocks",
    "bloom_address",
    "contiguous_prefix",
    "tx_ordinals",
    "checksum_address",
    "logs_by_topics",
    "get_logs",
    "logs_by_filter_table",
    "blocks_from_logs",
    "receipts_from_logs",
    "block_by_number",
    "receipt_by_hash",
    "event_counts",
]


def gate_many_blocks(spark: SparkSession, sf_dir: str) -> tuple[int, float]:
    """Blocks, and seconds to gate them by bloom: the stored headers many times over.

    The test tables have a few thousand blocks, too few to time skipping.
    """
    path = scratch_path(spark, "many-headers")
    copies = F.explode(F.sequence(F.lit(1), F.lit(HEADER_COPIES))).alias("copy")
    fixtures.headers(spark, sf_dir).select("*", copies).repartition(32).write.parquet(path)
    headers = spark.read.parquet(path)
    seconds = []
    for _ in range(2):
        begin = time.perf_counter()
        wanted = headers.where(mapping_gate(PAIR)).select("block_number")
        wanted.write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - begin)
    return headers.count(), seconds[-1]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("eventloom-bench")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        # Partitions small enough to keep every core busy on a small scale factor.
        .config("spark.sql.adaptive.advisoryPartitionSizeInBytes", "8m")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.conf.get("spark.checkpoint.dir", None):
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="eventloom-bench-"))

    started = time.perf_counter()
    fixtures.headers(spark, sf_dir)
    fixtures.settled_receipts(spark, sf_dir)
    fixtures.logs(spark, sf_dir)
    setup = time.perf_counter() - started

    def timed(name: str) -> float:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - begin, 3)

    cold, warm = {}, {}
    for name in HEADLINES:
        cold[name] = timed(name)
        warm[name] = timed(name)
    blocks, gate = gate_many_blocks(spark, sf_dir)
    raw_logs = fixtures.table(spark, sf_dir, "lineitem").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cold": cold,
                "setup_sec": round(setup, 3),
                "raw_logs_per_sec": round(raw_logs / warm["decode_transfers"]),
                "gated_blocks_per_sec": round(blocks / gate),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
