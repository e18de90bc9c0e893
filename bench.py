"""Headline queries at one scale factor, warm median of three; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from palisade.operators import chain, risk  # noqa: E402
from palisade.plans.catalog import QUERIES  # noqa: E402
from palisade.plans.integrity_queries import CONFIG  # noqa: E402
from palisade.session import configure, materialize, spread  # noqa: E402
from palisade.sources import tables  # noqa: E402

HEADLINE = (
    "audit_trend", "audit_kpi", "risk_top", "latency_percentiles", "redact_contacts", "mask_ip", "profile_evidence", "infer_types",
    "governed_revenue", "in_subquery", "table_access", "authorize_uses", "secure_rows", "grant_usage", "output_masks",
    "exposure_report", "risk_verdicts", "rate_limits", "keyword_scores", "match_vocabulary", "find_mentions",
    "cosine_top_k", "forecast_months", "retained_events", "differing_rows", "invalid_transitions",
)
ROUNDS = 3


def timed(run) -> float:
    started = time.perf_counter()
    run()
    return time.perf_counter() - started


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = configure(
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("palisade-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SCRATCH") or tempfile.mkdtemp(prefix="palisade-bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or [*HEADLINE, "assess_100k", "chain_build_100k", "chain_verify_100k"]
    seconds: dict[str, float] = {}

    def sink(df) -> None:
        df.write.format("noop").mode("overwrite").save()

    for name in wanted:
        if name in QUERIES:
            run = lambda name=name: sink(QUERIES[name](spark, sf_dir))
            run()
            seconds[name] = round(statistics.median(timed(run) for _ in range(ROUNDS)), 3)

    if "assess_100k" in wanted:
        # The rules alone, over stored signals, as the published decision throughput counts them.
        # Stored in as many files as there are cores: the given table is one row group, which one task would read.
        signals = materialize(spread(risk.with_agents(tables.query_signals(spark, sf_dir), tables.agents(spark, sf_dir))), "bench-signals")
        run = lambda: sink(risk.assess(signals).select("id", "decision", "risk", "reason_rule"))
        run()
        seconds["assess_100k"] = round(statistics.median(timed(run) for _ in range(ROUNDS)), 3)

    if any(n.startswith("chain_") for n in wanted):
        log = tables.audit_log(spark, sf_dir).withColumn("chain_id", F.lit("traffic")).drop("k")
        rows = log.count()
        build = lambda: sink(chain.build_chain(log, CONFIG))
        build()
        seconds["chain_build_100k"] = round(statistics.median(timed(build) for _ in range(ROUNDS)), 3)
        chained = materialize(log.join(chain.build_chain(log, CONFIG).drop("tenant_id", "chain_id"), "id"), "bench-chain")
        state = materialize(chain.chain_state(chained, CONFIG), "bench-state")
        verify = lambda: sink(chain.verify_chain(chained, state, CONFIG))
        verify()
        seconds["chain_verify_100k"] = round(statistics.median(timed(verify) for _ in range(ROUNDS)), 3)
        print(f"chain rows: {rows}", file=sys.stderr)

    print(
        json.dumps(
            {
                "metric": "warm median of headline queries, summed",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).replace("sf", ""),
            }
        )
    )


if __name__ == "__main__":
    main()
