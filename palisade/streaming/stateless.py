"""Streams built from plain expressions, joins with static tables and windowed aggregates."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.masks import HashKey
from palisade.operators.audit import REQUEST_BUCKETS, is_intent
from palisade.operators.redact import MaskRule, redact, redact_observed
from palisade.operators.policy import resolve_policies
from palisade.operators.risk import DEFAULTS, assess, with_facts
from palisade.session import materialize
from palisade.streaming.ordered import rate_limit
from palisade.streaming.runtime import run_batches

# Fixed value: decisions a channel gets when it names none.
DEFAULT_DECISIONS = ("deny", "error")
# Texts of rows that travel through a state keep all digits of their times.
TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def dedupe_events(stream: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each event uuid once within the delay; the state of older ones is dropped."""
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    return timed.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["event_uuid"])


def channel_routes(channels: DataFrame) -> DataFrame:
    """Enabled channels as (tenant_id, decision, channel_id) rows; without decisions the defaults hold."""
    fallback = F.array(*[F.lit(x) for x in DEFAULT_DECISIONS])
    wanted = F.when(F.size("decisions") > 0, F.col("decisions")).otherwise(fallback)
    return channels.filter("enabled").select(
        "tenant_id", "channel_id", F.explode(F.array_distinct(F.transform(wanted, lambda x: F.lower(F.trim(x))))).alias("decision")
    )


def route_alerts(stream: DataFrame, channels: DataFrame) -> DataFrame:
    """Every event paired with the channels that want its decision; intent rows go nowhere."""
    open_rows = stream.filter(~is_intent(F.col("details_json"))) if "details_json" in stream.columns else stream
    keyed = open_rows.withColumn("decision", F.lower(F.trim("decision")))
    return keyed.join(channel_routes(channels), ["tenant_id", "decision"])


def batch_writer(path: str, shape: Callable[[DataFrame], DataFrame] = lambda df: df) -> Callable[[DataFrame, int], None]:
    """A foreachBatch sink: one folder per batch number, so a repeated batch replaces itself."""

    def write(batch: DataFrame, epoch: int) -> None:
        shape(batch).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return write


def stream_metrics(
    stream: DataFrame, width: str = "1 hour", delay: str = "10 minutes", bounds: Sequence[float] = REQUEST_BUCKETS
) -> DataFrame:
    """Tumbling-window counters per decision with a cumulative latency histogram."""
    seconds = F.col("latency_ms").cast("double") / 1000
    timed = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", width), "tenant_id", "decision").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("latency_ms").alias("latency_sum_ms"),
        *[F.count_if(seconds <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds],
    ).withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def redact_stream(stream: DataFrame, rules: Sequence[MaskRule], key: HashKey | None = None) -> DataFrame:
    return redact(stream, rules, key)


def redact_reported(stream: DataFrame, rules: Sequence[MaskRule], key: HashKey | None = None) -> tuple[DataFrame, DataFrame]:
    """The redacted stream and a report of each micro-batch (see redact_observed) with its number, as written tables."""

    def each(batch: DataFrame, number: int) -> dict:
        frame, report = redact_observed(batch, rules, key)
        return {"redacted": frame, "report": lambda: report().withColumn("batch_no", F.lit(number).cast("long"))}

    out = run_batches(stream, "redacted", each)
    return out["redacted"], out["report"]


def assess_stream(
    stream: DataFrame, agents: DataFrame, policies: DataFrame, metadata: DataFrame, config: DataFrame | None = None,
    qps: float = DEFAULTS["qps_per_agent"], max_concurrent: int = DEFAULTS["max_conns_per_datasource"], delay: str | None = None,
) -> DataFrame:
    """Live verdicts of all rules over a stream of signals (with ts and latency_ms), as a written table.

    Each request passes its agent's token bucket first, with the thresholds that `config` (see risk.resolve_config) sets
    for it, and goes on to the verdict as a whole row, so nothing is known of it but agents, policies, table metadata
    and configuration. The bucket's state is kept between micro-batches (see ordered.rate_limit); access, table facts and
    verdict are worked out for one micro-batch at a time, by the functions of the batch form.
    """
    if config is not None:
        stream = stream.join(config, ["agent_id", "datasource_id"], "left")
    shape = T.StructType([f for f in stream.schema.fields if f.name != "rate_limited"])
    limited = rate_limit(stream, qps, max_concurrent, delay=delay, carried=F.to_json(F.struct(*shape.fieldNames()), TIMES))
    resolved = materialize(resolve_policies(policies), "resolved-policies")

    def judge(batch: DataFrame, number: int) -> dict[str, DataFrame]:
        requests = batch.select(F.from_json("carried", shape, TIMES).alias("r"), (F.col("limit_reason") != "").alias("rate_limited"))
        return {"verdicts": assess(with_facts(requests.select("r.*", "rate_limited"), agents, resolved, metadata))}

    return run_batches(limited, "assess", judge)["verdicts"]
