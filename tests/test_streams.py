"""Streams over several micro-batches, with late, lost and repeated rows; batch twins agree."""

from __future__ import annotations

import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from palisade.operators import risk as rk
from palisade.session import scratch_path
from palisade.sources import tables as t
from palisade.streaming import ordered as o
from palisade.streaming import stateless as sl
from palisade.plans import catalog
from palisade.streaming import runtime
from palisade.streaming.runtime import replay_in_order, run_available, stream_folder

START = dt.datetime(2024, 1, 1)


def batches(spark, frames):
    """One file per frame, read one per micro-batch in this order."""
    path = scratch_path(spark, "batches")
    for i, frame in enumerate(frames):
        frame.coalesce(1).write.mode("append").parquet(path)
    return stream_folder(spark, path, frames[0], files_per_batch=1)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def events(spark, seqs, tenant="t0", minute=0):
    data = [(tenant, s, s * 10, START + dt.timedelta(minutes=minute)) for s in seqs]
    return spark.createDataFrame(data, "tenant_id string, seq bigint, id bigint, ts timestamp")


def test_ordered_stream_waits_then_reports_gaps(spark):
    feed = batches(spark, [
        events(spark, [2, 1, 5], minute=0),
        events(spark, [4, 7, 8, 1], minute=1),
        events(spark, [3, 12, 22], minute=2),
        events(spark, [100], tenant="~", minute=60),
        events(spark, [101], tenant="~", minute=120),
    ])
    out = run_available(o.audit_stream(feed, block=10), "ordered").filter("tenant_id = 't0'")
    got = rows(out.select("kind", "seq", "gap_end"))
    assert [s for k, s, _ in got if k == "event"] == [1, 12, 2, 22, 3, 4, 5, 7, 8]
    assert [(s, e) for k, s, e in got if k == "gap"] == [(13, 21), (6, 6), (9, 11)]


def test_ordered_stream_reports_empty_blocks_and_a_cursor_in_a_gap(spark):
    feed = batches(spark, [
        events(spark, [3, 4, 18], minute=0),
        events(spark, [61, 62, 4], minute=1),
        events(spark, [95], minute=2),
        events(spark, [1000], tenant="~", minute=60),
        events(spark, [1001], tenant="~", minute=120),
    ])
    out = run_available(o.audit_stream(feed, cursor=6, block=10), "empty-blocks").filter("tenant_id = 't0'")
    assert rows(out.filter("kind = 'gap'").select("seq", "gap_end")) == [(19, 60), (63, 94), (7, 17)]
    assert rows(out.filter("kind = 'event'").select("seq")) == [(18,), (61,), (62,), (95,)]


def test_a_page_says_whether_the_tail_is_missing(spark):
    df = events(spark, [1, 2, 3]).unionByName(events(spark, [2, 3], tenant="t1")).unionByName(events(spark, [1, 2], tenant="t2"))
    tail = spark.createDataFrame([("t0", 4), ("t1", 3), ("t2", 2), ("t3", 0)], "tenant_id string, seq bigint")
    got = rows(o.stream_after(df, 0, latest=tail).select("tenant_id", "seq", "consistent"))
    assert got == [("t0", 1, False), ("t0", 2, False), ("t0", 3, False), ("t1", None, False), ("t2", 1, True), ("t2", 2, True)]
    assert rows(o.sequence_gaps(df, latest=tail)) == [("t0", 4, 4), ("t1", 1, 1)]


def test_cursor_skips_what_was_delivered(spark):
    feed = batches(spark, [events(spark, [1, 2, 3, 4, 5, 6]), events(spark, [7])])
    out = run_available(o.audit_stream(feed, cursor=4, block=10), "cursor")
    assert sorted(r["seq"] for r in out.collect()) == [5, 6, 7]


def test_batch_pages_stop_at_a_gap(spark):
    df = events(spark, [1, 2, 3, 5, 6]).unionByName(events(spark, [1, 2], tenant="t1"))
    assert rows(o.sequence_gaps(df, block=2)) == [("t0", 4, 4)]
    assert rows(o.stream_after(df, 1).select("tenant_id", "seq")) == [("t0", 2), ("t0", 3), ("t1", 2)]


def by_day(df, days=3):
    return [df.filter(F.dayofmonth("ts") % days == i) for i in range(days)]


@pytest.fixture(scope="module")
def parts(spark, sf_dir):
    """The log cut into three time ranges."""
    log = t.audit_log(spark, sf_dir)
    marks = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 20), dt.datetime(2024, 2, 1)]
    cast = lambda m: F.lit(m).cast("timestamp_ntz")
    return log, [log.filter((F.col("ts") >= cast(a)) & (F.col("ts") < cast(b))) for a, b in zip(marks, marks[1:])]


def test_rate_limit_stream_equals_batch(spark, parts):
    log, cut = parts
    slow = lambda df: df.withColumn("latency_ms", F.col("latency_ms") * 60000)
    live = run_available(o.rate_limit(batches(spark, [slow(p) for p in cut]), 0.0005, 2), "limits")
    assert rows(live) == rows(rk.rate_limits(slow(log), 0.0005, 2))


def test_attempt_stream_equals_batch(spark, parts):
    log, cut = parts
    live = run_available(o.attempt_limit(batches(spark, cut), "agent_id", 2, 86400.0), "attempts")
    assert rows(live) == rows(o.attempt_limits(log, "agent_id", 2, 86400.0))


def test_delivery_stream_equals_batch(spark, parts):
    log, cut = parts
    shape = lambda df: df.select(
        "id", "tenant_id", F.col("datasource_id").alias("channel_id"), "ts",
        F.element_at(F.array(*[F.lit(a) for a in ("claim", "ack", "fail", "claim", "replay")]), F.col("k") % 5 + 1).alias("action"),
        (1 + F.col("k") % 3).cast("bigint").alias("seq"), F.concat(F.lit("w"), (F.col("k") % 2).cast("string")).alias("token"),
    )
    live = run_available(o.delivery_state(batches(spark, [shape(p) for p in cut]), 3, 7200.0), "delivery")
    assert rows(live) == rows(o.delivery_states(shape(log), 3, 7200.0))


def test_rows_of_a_key_are_merged_from_sorted_runs(monkeypatch):
    """No frame that comes out, and no sort, holds more than a part of the key."""
    frame = pd.DataFrame({"at_s": [float(i * 7919 % 5003 // 3) for i in range(5003)], "id": range(5003)})
    monkeypatch.setattr(o, "READ_ROWS", 50)
    parts = [frame[lo : lo + 100] for lo in range(0, 5003, 100)]
    got = list(o._in_order(iter(parts), 1000))
    assert max(map(len, got)) <= 6 * 50
    assert pd.concat(got).values.tolist() == frame.sort_values(["at_s", "id"]).values.tolist()
    assert len(list(o._in_order(iter(parts), 10_000))) == 1 and list(o._in_order(iter([]), 10)) == []


def test_ordered_replay_is_cut_into_batches_of_time(spark):
    data = [("a", i, START + dt.timedelta(minutes=i * 37 % 500) if i % 50 else None) for i in range(500)]
    df = spark.createDataFrame(data, "tenant_id string, id bigint, ts timestamp").repartition(5)
    seen = []
    collect = lambda batch, _: seen.append([(r.ts or dt.datetime.min, r.id) for r in batch.collect()])
    stream = replay_in_order(spark, df, rows_per_batch=120)
    stream.writeStream.foreachBatch(collect).option("checkpointLocation", scratch_path(spark, "c")).trigger(availableNow=True).start().awaitTermination()
    assert [len(b) for b in seen] == [120, 120, 120, 120, 20]
    assert [r for b in seen for r in sorted(b)] == sorted((ts or dt.datetime.min, i) for _, i, ts in data)
    assert run_available(replay_in_order(spark, df.limit(0)), "none").count() == 0


@pytest.mark.parametrize("name, twin", [("rate_limit_stream", "rate_limits"), ("attempt_limit_stream", "attempt_limits"), ("delivery_state_stream", "delivery_states")])
def test_stream_queries_run_in_bounded_batches(spark, sf_dir, monkeypatch, name, twin):
    """The registered queries over several micro-batches, whose keys are longer than one sort."""
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    plain, before = {n: getattr(o, n) for n in ("rate_limit", "attempt_limit", "delivery_state")}, spark.conf.get(size)
    monkeypatch.setattr(runtime, "BATCH_ROWS", t.audit_log(spark, sf_dir).count() // 3 + 1)
    for n, f in plain.items():
        monkeypatch.setattr(o, n, lambda *a, f=f: f(*a, sort_rows=4))
    spark.conf.set(size, 3)
    try:
        got = catalog.QUERIES[name](spark, sf_dir)
        assert rows(got) == rows(catalog.QUERIES[twin](spark, sf_dir).select(*got.columns))
    finally:
        spark.conf.set(size, before)


def test_delivery_cursor_rules():
    cursor = o.DeliveryCursor(None, max_failures=2, lease_s=60)
    assert not cursor.apply("ack", 1, 0.0, "a") and not cursor.apply("claim", 0, 0.0, "")
    assert cursor.apply("claim", 0, 0.0, "a") and not cursor.apply("claim", 0, 1.0, "b")
    assert not cursor.apply("ack", 2, 2.0, "a") and not cursor.apply("ack", 1, 2.0, "b") and cursor.apply("ack", 1, 2.0, "a")
    assert cursor.apply("claim", 0, 3.0, "a") and cursor.apply("fail", 0, 4.0, "a")
    assert cursor.s["retry_after"] == 14.0 and not cursor.apply("claim", 0, 13.0, "a")
    assert cursor.apply("claim", 0, 14.0, "a") and cursor.apply("fail", 0, 15.0, "a") and cursor.s["dead"]
    assert not cursor.apply("claim", 0, 10_000.0, "a") and cursor.apply("replay", 0, 10_000.0, "") and cursor.apply("claim", 0, 10_001.0, "a")
    assert [o.retry_delay(n) for n in (-1, 0, 1, 2, 3, 4, 9)] == [10, 10, 30, 60, 300, 900, 900]


def test_a_stale_worker_cannot_move_the_cursor():
    cursor = o.DeliveryCursor(None, max_failures=2, lease_s=60)
    assert cursor.apply("claim", 0, 0.0, "old") and cursor.apply("claim", 0, 61.0, "new")
    assert not cursor.apply("ack", 1, 62.0, "old") and not cursor.apply("fail", 0, 62.0, "old") and not cursor.apply("release", 0, 62.0, "old")
    assert cursor.apply("release", 0, 63.0, "new") and not cursor.apply("ack", 1, 64.0, "new")
    assert cursor.apply("claim", 0, 64.0, "old") and cursor.apply("ack", 1, 65.0, "old") and cursor.s["last_seq"] == 1


def test_recent_keeps_the_newest_over_batches(spark, parts):
    log, cut = parts
    shape = lambda df: df.select("tenant_id", F.col("id").alias("seq"), "id")
    rings = run_available(o.recent_stream(batches(spark, [shape(p) for p in cut]), 50), "recent")
    assert rows(o.recent_of(rings, 50)) == rows(o.recent(shape(log), 50))


def test_late_rows_go_to_the_side(spark):
    feed = batches(spark, [events(spark, range(1, 40), minute=100), events(spark, range(40, 80), minute=10), events(spark, range(80, 120), minute=101)])
    out = run_available(o.flag_late(feed, 600.0, salts=2), "late")
    assert {r["id"] for r in out.filter("late").collect()} == {s * 10 for s in range(40, 80)}


def test_duplicates_across_batches_are_dropped(spark):
    frame = events(spark, range(1, 30)).withColumn("event_uuid", F.md5(F.col("id").cast("string")))
    out = run_available(sl.dedupe_events(batches(spark, [frame, frame.limit(20), frame])), "dedupe")
    assert out.count() == 29


def test_foreach_batch_sink_is_idempotent(spark):
    path = scratch_path(spark, "sink")
    write = sl.batch_writer(path)
    frame = events(spark, [1, 2])
    write(frame, 0)
    write(frame, 0)
    write(frame, 1)
    assert spark.read.parquet(path).count() == 4


def test_gaps_between_blocks_show_while_the_stream_runs(spark):
    """Three empty blocks appear as one range once the wait is over, in the batch whose watermark ends it, not at the end."""
    frames = [
        events(spark, [1, 2, 3], minute=0),
        events(spark, [51, 52], minute=1),
        events(spark, [900], tenant="~", minute=20),
        events(spark, [901], tenant="~", minute=21),
        events(spark, [53, 54, 55, 56, 57, 58, 59, 60], minute=22),
        events(spark, [902], tenant="~", minute=60),
        events(spark, [903], tenant="~", minute=61),
    ]
    out = runtime.run_batches(o.audit_stream(batches(spark, frames), block=10), "live-gaps", lambda b, n: {"rows": b.withColumn("number", F.lit(n))})["rows"]
    own = out.filter("tenant_id = 't0'")
    gaps = rows(own.filter("kind = 'gap'").select("seq", "gap_end", "number"))
    assert [(a, b) for a, b, _ in gaps] == [(4, 50)] and gaps[0][2] <= 4
    assert [r.seq for r in own.filter("kind = 'event'").orderBy("seq").collect()] == [1, 2, 3, *range(51, 61)]
    late_number = own.filter("seq = 60").first()["number"]
    assert gaps[0][2] < late_number  # before the block's later events had even come


class _Counted:
    """State in memory, for a value (key None) or a map, that counts its calls."""

    def __init__(self, calls):
        self.calls, self.rows = calls, {}

    def __getattr__(self, name):
        held = self.rows
        call = {
            "exists": lambda: bool(held), "get": lambda: held.get(None), "update": lambda v: held.update({None: v}), "clear": held.clear,
            "containsKey": lambda k: k in held, "getValue": held.get, "updateValue": lambda k, v: held.update({k: v}), "removeKey": held.pop,
            "iterator": lambda: iter(list(held.items())), "keys": lambda: iter(list(held)), "values": lambda: iter(list(held.values())),
        }[name]
        return lambda *a: (self.calls.append(name), call(*a))[1]


def test_waiting_events_cost_a_few_calls_to_the_state_a_block():
    class Handle:
        calls, made, timers = [], {}, []

        def getValueState(self, name, schema):
            return self.made.setdefault(name, _Counted(self.calls))

        getMapState = lambda self, name, *schemas: self.getValueState(name, None)

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, now):
            self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: now

    handle, step, given = Handle(), o._OrderedBlock(2000, 0), []
    step.init(handle)
    # Number 2000 is missing and all others wait for it, but for a second hole; copies of a waiting number do nothing.
    numbers = [n for n in range(2001, 4000) if n != 3000]
    for part in (numbers[::2], numbers[1::2] + numbers[:50]):
        batch = pd.DataFrame({"seq": part, "id": [n * 10 if n % 5 else None for n in part], "at_ms": [1000] * len(part)})
        given += list(step.handleInputRows(("t", 1), iter([batch]), Clock(0)))
    given += list(step.handleExpiredTimer(("t", 1), Clock(1000), Clock(handle.timers[0])))
    out = pd.concat(given)
    assert [tuple(x) for x in out[out.kind == "gap"][["seq", "gap_end"]].values] == [(3000, 3000)]
    events = out[out.kind == "event"]
    assert events.seq.tolist() == numbers and [None if pd.isna(i) else i for i in events.id] == [n * 10 if n % 5 else None for n in numbers]
    assert not handle.made["held"].rows and len(handle.calls) < 60


def test_closed_blocks_leave_no_state(spark):
    frames = [events(spark, range(1, 40)), events(spark, [45], minute=1), events(spark, [500], tenant="~", minute=60), events(spark, [501], tenant="~", minute=90)]
    stream, checkpoint = o.audit_stream(batches(spark, frames), block=10), scratch_path(spark, "closed-checkpoint")
    query = stream.writeStream.format("parquet").option("path", scratch_path(spark, "closed")).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    held = {}
    for number in (0, 1):  # which of the two steps has which number is Spark's choice
        for name in ("state", "reached"):
            reader = spark.read.format("statestore").option("path", checkpoint).option("operatorId", number).option("stateVarName", name)
            try:
                held[name] = [tuple(r["key"]) for r in reader.load().select("key").collect()]
            except Exception as problem:  # noqa: BLE001
                assert "variable" in str(problem).lower()
    # Blocks 0 to 3 are whole and quiet: only the unfinished one is left; the tenant's step keeps one number.
    assert ("t0", 4) in held["state"] and not any(("t0", b) in held["state"] for b in range(4))
    assert ("t0", -1) in held["reached"]


def test_live_verdicts_equal_the_batch(spark, sf_dir):
    """At least five micro-batches, rate limits as requests come in, thresholds of some agents set by configuration."""
    from palisade.operators.policy import resolve_policies
    from palisade.plans import risk_queries

    signals = t.query_signals(spark, sf_dir).withColumn("latency_ms", F.col("latency_ms") * 60000)
    agents, policies, metadata = t.agents(spark, sf_dir), t.policies(spark, sf_dir), risk_queries.metadata(spark)
    layers = spark.createDataFrame([("agent", "agent-3", "R008", True, False, {"qps_per_agent": 0.01}), ("agent", "agent-4", "R008", False, False, {})],
                                   "layer string, scope_id string, rule_id string, enabled boolean, explicit_deny boolean, thresholds map<string,double>")
    config = rk.resolve_config(signals, layers)
    known = signals.join(config, ["agent_id", "datasource_id"], "left")
    limited = rk.rate_limits(known, 0.0005, 2).filter("limit_reason <> ''").select("id")
    expected = rk.assess(rk.with_facts(known, agents, resolve_policies(policies), metadata, limited))
    feed = replay_in_order(spark, signals, rows_per_batch=-(-signals.count() // 5), files=2)
    got = sl.assess_stream(feed, agents, policies, metadata, config, 0.0005, 2)
    shown = ["id", "decision", "risk", "reason_rule", "failed_closed", F.to_json("hits")]
    assert rows(got.select(*shown)) == rows(expected.select(*shown))
    assert expected.filter("exists(hits, h -> h.rule_id = 'R008')").count() > 0


def test_a_full_bucket_leaves_no_state(spark):
    frame = lambda ids, minute, agent: spark.createDataFrame(
        [("t", agent, i, START + dt.timedelta(minutes=minute, seconds=i), 1000) for i in ids], "tenant_id string, agent_id string, id bigint, ts timestamp, latency_ms bigint"
    )
    frames = [frame([1, 2, 3], 0, "a"), frame([4, 5], 30, "b"), frame([6], 90, "b"), frame([7], 91, "a"), frame([8], 200, "b"), frame([9], 230, "b")]
    checkpoint, out = scratch_path(spark, "idle-checkpoint"), scratch_path(spark, "idle")
    stream = o.rate_limit(batches(spark, frames), qps=1, max_concurrent=2, delay="1 minute")
    stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    everything = frames[0]
    for f in frames[1:]:
        everything = everything.unionByName(f)
    assert rows(spark.read.schema(stream.schema).parquet(out)) == rows(rk.rate_limits(everything, 1, 2))
    state = spark.read.format("statestore").option("path", checkpoint).option("stateVarName", "state").load()
    assert "a" not in {r["key"]["agent_id"] for r in state.select("key").collect()}


LATE_ORDER = [(0, 30), (2, 0), (40, 10), (60, 35), (61, 5)]  # minutes of two groups of events in each of five batches


def late_frames(spark):
    """Five batches; in each some events are newer, and some up to an hour behind."""
    rows_, seq = [], 0
    for number, (fresh, old) in enumerate(LATE_ORDER):
        part = []
        for minute in (fresh, old):
            for _ in range(6):
                seq += 1
                part.append((f"t{seq % 2}", seq, seq, START + dt.timedelta(minutes=minute, seconds=seq), f"u{seq % 9}", "deny", 5, f"User{seq % 2}"))
        rows_.append(part)
    schema = "tenant_id string, seq bigint, id bigint, ts timestamp, event_uuid string, decision string, latency_ms bigint, user_name string"
    return [spark.createDataFrame(part, schema) for part in rows_], sum(rows_, [])


def test_late_rows_are_kept_apart_and_streams_drop_no_other(spark):
    """Five batches: on-time and late rows are the input, and T1, T2, T4 and T6 behind the split use every on-time row."""
    frames, everything = late_frames(spark)
    folder = scratch_path(spark, "on-time")
    on_time, late = runtime.split_late(batches(spark, frames), "ts", "10 minutes", folder)
    assert rows(on_time.unionByName(late).select("id")) == sorted(((r[2],) for r in everything), key=repr)
    newest, expected = None, set()
    for frame in frames:
        found = frame.collect()
        expected |= {r.id for r in found if newest is None or r.ts > newest - dt.timedelta(minutes=10)}
        newest = max([r.ts for r in found] + ([newest] if newest else []))
    kept = on_time.collect()
    assert {r.id for r in kept} == expected and len(expected) < len(everything) - 10
    feed = lambda: runtime.follow(spark, f"{folder}/on_time", on_time, files_per_batch=1)

    given = run_available(o.audit_stream(feed(), block=5), "late-audit").filter("kind = 'event'")
    # The newest ones still wait for the numbers before them, and so do those behind them in a block.
    over = {r.id for r in kept if r.ts <= newest - dt.timedelta(minutes=10)}
    ahead = lambda r: {x.id for x in kept if x.tenant_id == r.tenant_id and x.seq // 5 == r.seq // 5 and x.seq <= r.seq}
    released = {r.id for r in kept if ahead(r) <= over}
    assert len(released) > 20 and released <= {r.id for r in given.collect()} <= expected
    deduped = run_available(sl.dedupe_events(feed(), "10 minutes"), "late-dedupe")
    assert {r.event_uuid for r in deduped.collect()} == {r.event_uuid for r in kept}
    tries = run_available(o.attempt_limit(feed(), "user_name", 3, 600.0, "10 minutes"), "late-attempts")
    assert {r.id for r in tries.collect()} == expected
    metrics = run_available(sl.stream_metrics(feed(), "15 minutes", "10 minutes"), "late-metrics")
    # Windows that the last watermark has passed are given out, with all of their on-time rows.
    ends = [START + dt.timedelta(minutes=15) * (int((r.ts - START).total_seconds() // 900) + 1) for r in kept]
    assert metrics.agg(F.sum("n")).first()[0] == sum(end <= newest - dt.timedelta(minutes=10) for end in ends) > 0


def test_a_replay_spreads_each_batch_over_files(spark, sf_dir):
    log = t.audit_log(spark, sf_dir).select("id", "ts")
    sizes = runtime.run_batches(replay_in_order(spark, log, rows_per_batch=40, files=3), "spread", lambda b, n: {"n": b.agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"))})["n"]
    got = sorted(map(tuple, sizes.collect()), key=lambda r: r[1])
    assert sum(n for n, _, _ in got) == log.count() and max(n for n, _, _ in got) <= 40
    assert all(a[2] <= b[1] for a, b in zip(got, got[1:]))


def test_streams_go_on_from_a_batch_run(spark, parts):
    log, cut = parts
    slow = lambda df: df.withColumn("latency_ms", F.col("latency_ms") * 60000)
    before = cut[0].unionByName(cut[1])
    for blocks in ({}, {"max_block_rows": 20}):
        states = rk.rate_limit_states(slow(before), 0.0005, 2, **blocks)
        live = run_available(o.rate_limit(batches(spark, [slow(cut[2])]), 0.0005, 2, states=states), "resumed")
        assert rows(live.unionByName(rk.rate_limits(slow(before), 0.0005, 2))) == rows(rk.rate_limits(slow(log), 0.0005, 2))
    states = o.attempt_limit_states(before, "agent_id", 2, 86400.0)
    live = run_available(o.attempt_limit(batches(spark, [cut[2]]), "agent_id", 2, 86400.0, states=states), "resumed-attempts")
    assert rows(live.unionByName(o.attempt_limits(before, "agent_id", 2, 86400.0))) == rows(o.attempt_limits(log, "agent_id", 2, 86400.0))
