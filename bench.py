"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallyguard.plans.queries import QUERIES  # noqa: E402
from tallyguard.session import local_session  # noqa: E402

HEADLINE = [
    "extract_fields", "intake_validation", "feat_amount_zscore", "features_incremental",
    "closest_match", "duplicate_screen", "ensemble_assess", "route_decisions", "notifications",
    "queue_upsert", "intake_events", "review_replay", "chain_build", "chain_verify",
    "batch_summary", "fp_trend", "vendor_risk_summary", "feedback_dataset", "train_models",
]


def main() -> None:
    with tempfile.TemporaryDirectory(prefix="bench-") as shared:
        run(shared)


def run(shared: str) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench",
                          **{"spark.checkpoint.dir": shared})
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()    # start the executors
    seconds = {}
    for name in names:
        start = time.monotonic()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.monotonic() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
