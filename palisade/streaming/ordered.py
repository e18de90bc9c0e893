"""Streams whose result depends on order: gap detection, rate and attempt limits, delivery, history."""

from __future__ import annotations

import contextlib
import json
import pickle
import tempfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from palisade.functions.folds import MAX_BLOCK_ROWS, ordered_fold, ordered_states
from palisade.functions.segments import join_same, previous, time_slice
from palisade.operators.risk import DEFAULTS, TokenBucket, limit_rows

SEQ_BLOCK = 10_000
_TEXT = T.StructType([T.StructField("value", T.StringType())])


class _JsonState:
    """One JSON document per key."""

    def __init__(self, handle: StatefulProcessorHandle, name: str = "state"):
        self.cell = handle.getValueState(name, _TEXT)

    def read(self) -> dict | None:
        return json.loads(self.cell.get()[0]) if self.cell.exists() else None

    def write(self, value: dict) -> None:
        self.cell.update((json.dumps(value),))

    def clear(self) -> None:
        self.cell.clear()


class _Resumable(StatefulProcessor):
    """A processor whose state is one JSON document, which a batch run (folds.ordered_states) may hand over."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, _JsonState(handle)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        self.state.write(json.loads(initialState["state"].iloc[0]))

    def close(self) -> None:
        pass


def _started(states: DataFrame | None, *keys: str):
    return None if states is None else states.select(*keys, "state").groupBy(*keys)


# Rows of a key that are sorted in memory at once, and rows read back at once from each sorted run.
SORT_ROWS, READ_ROWS = 50_000, 1_000
_ORDER = ["at_s", "id"]


def _spilled(frame: pd.DataFrame, stack: contextlib.ExitStack) -> Iterator[pd.DataFrame]:
    """A sorted run, kept in an unnamed local file and read back in small frames."""
    file = stack.enter_context(tempfile.TemporaryFile())
    for lo in range(0, len(frame), READ_ROWS):
        pickle.dump(frame[lo : lo + READ_ROWS], file)
    file.seek(0)

    # The reader must not hold the frame.
    return (pickle.load(file) for _ in range(0, len(frame), READ_ROWS))


def _merged(runs: list[Iterator[pd.DataFrame]]) -> Iterator[pd.DataFrame]:
    heads = {i: next(run) for i, run in enumerate(runs)}
    while heads:
        both = pd.concat([h.assign(__run=i) for i, h in heads.items()]).sort_values(_ORDER, kind="stable", ignore_index=True)
        # Up to the first row that ends a run's frame no row in a file can come earlier.
        cut = both["__run"].drop_duplicates(keep="last").index.min()
        done, rest = both["__run"][cut], both[cut + 1 :]
        yield both[: cut + 1].drop(columns="__run")
        heads = {i: rest[rest["__run"] == i].drop(columns="__run") for i in heads if i != done}
        fresh = next(runs[done], None)
        if fresh is not None:
            heads[done] = fresh


def _in_order(rows: Iterator[pd.DataFrame], most: int) -> Iterator[pd.DataFrame]:
    """The rows of one key in time order, in frames. Spark refuses to sort a stream, and hands a key's rows over unordered.

    About `most` rows are held; of more, sorted runs go to local disk and are merged, `READ_ROWS` of each at a time.
    """
    with contextlib.ExitStack() as stack:
        runs, held, n = [], [], 0
        for batch in rows:
            held.append(batch)
            n += len(batch)
            if n >= most:
                runs.append(_spilled(pd.concat(held).sort_values(_ORDER), stack))
                held, n = [], 0
        if held:
            rest = pd.concat(held).sort_values(_ORDER)
            runs.append(iter([rest]) if not runs else _spilled(rest, stack))
        yield from _merged(runs) if len(runs) > 1 else (frame for run in runs for frame in run)


STREAM_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.LongType()),
        T.StructField("kind", T.StringType()),
        T.StructField("gap_end", T.LongType()),
    ]
)


_NUMBER = T.StructType([T.StructField("n", T.LongType())])
# What a block step hands over: events and gaps of its own, and notices about the block for the tenant's step.
_STEP_SCHEMA = T.StructType(
    [*STREAM_SCHEMA.fields, T.StructField("lane", T.LongType()), T.StructField("version", T.LongType()), T.StructField("at", T.TimestampType())]
)
_NOTICES = -1
# Numbers whose waiting events are one entry of the state: each call to the state costs more than its bytes.
PACK = 512
KEEP_MS = 7 * 86_400_000


class _OrderedBlock(StatefulProcessor):
    """Releases one block of a tenant's sequence in order; numbers that stay away before a later one become gap rows.

    A hole at the block's start belongs to a range that may begin in an earlier block, so it is left to the tenant's
    step, which is told when the block opens (events that may still have to wait) and when it closes: the first number given
    out and the next one expected.
    """

    def __init__(self, block: int, cursor: int):
        self.block, self.cursor = block, cursor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, _JsonState(handle)
        # Events that wait for an earlier number: a map, so a batch writes only the packs of its own numbers.
        self.held = handle.getMapState("held", _NUMBER, _TEXT)

    def _read(self, key) -> tuple[dict, dict[int, tuple]]:
        """The block's state, and its waiting events (id, time) by number: at most a block's."""
        fresh = {"next": max(int(key[1]) * self.block, self.cursor + 1), "first": None, "open": False, "version": 0, "latest": 0, "timer": None, "retire": None}
        state, self.touched, self.packs = self.state.read(), set(), set()
        if state is None:
            return fresh, {}
        waiting = {}
        for (pack,), (text,) in self.held.iterator():
            self.packs.add(pack)
            waiting |= {seq: (row_id, at) for seq, row_id, at in json.loads(text)}
        return state, waiting

    def _write(self, state: dict, waiting: dict[int, tuple]) -> None:
        for pack in sorted(self.touched):
            kept = [(seq, *waiting[seq]) for seq in range(pack * PACK, (pack + 1) * PACK) if seq in waiting]
            if kept:
                self.held.updateValue((pack,), (json.dumps(kept),))
            elif pack in self.packs:
                self.held.removeKey((pack,))
        self.state.write(state)

    def _rows(self, key, timerValues, state: dict, events, gaps, notices) -> pd.DataFrame:
        tenant, lane = key[0], int(key[1])
        rows = [(tenant, seq, row_id, "event", None, lane, 0) for seq, row_id in events]
        rows += [(tenant, begin, None, "gap", end, lane, 0) for begin, end in gaps]
        rows += [(tenant, lane, first, kind, upto, _NOTICES, version) for kind, first, upto, version in notices]
        out = pd.DataFrame(rows, columns=_STEP_SCHEMA.fieldNames()[:-1])
        # What a step gives out must not be older than the watermark.
        out["at"] = pd.Timestamp(max(state["latest"], timerValues.getCurrentWatermarkInMs() + 1), unit="ms")
        return out.astype({c: "Int64" for c in ("seq", "id", "gap_end", "lane", "version")})

    def _drain(self, state: dict, waiting: dict[int, tuple]) -> list[tuple[int, int]]:
        events = []
        while state["next"] in waiting:
            events.append((state["next"], waiting.pop(state["next"])[0]))
            self.touched.add(state["next"] // PACK)
            state["next"] += 1
        if events and state["first"] is None:
            state["first"] = events[0][0]
        return events

    def _notice(self, state: dict, kind: str) -> tuple:
        state["open"], state["version"] = kind == "open", state["version"] + 1
        return kind, state["first"], state["next"], state["version"]

    def _settle(self, key, state: dict, waiting: list, notices: list, now: int) -> None:
        """Timers for what still waits, or the end of the block."""
        whole = state["next"] >= (int(key[1]) + 1) * self.block
        if not waiting and state["open"] and (whole or state["latest"] <= now):
            notices.append(self._notice(state, "closed"))
        # The watermark trails the newest event by the waiting time, so it passes this point only after that long.
        target = min(waiting) if waiting else state["latest"]
        if target > now and (state["timer"] is None or target < state["timer"] or state["timer"] <= now):
            state["timer"] = target
            self.handle.registerTimer(target)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (state, waiting), notices, now = self._read(key), [], timerValues.getCurrentWatermarkInMs()
        for batch in rows:
            state["latest"] = max(state["latest"], int(batch["at_ms"].max()))
            for seq, row_id, at in zip(batch["seq"].tolist(), batch["id"].tolist(), batch["at_ms"].tolist()):
                if seq >= state["next"] and seq not in waiting:
                    waiting[seq] = (None if pd.isna(row_id) else int(row_id), max(int(at), now + 1))
                    self.touched.add(seq // PACK)
        if not state["open"]:
            notices.append(self._notice(state, "open"))
        events = self._drain(state, waiting)
        self._settle(key, state, [at for _, at in waiting.values()], notices, now)
        self._write(state, waiting)
        yield self._rows(key, timerValues, state, events, [], notices)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        (state, waiting), now, fired = self._read(key), timerValues.getCurrentWatermarkInMs(), expiredTimerInfo.getExpiryTimeInMs()
        if state["timer"] is None or (fired not in (state["timer"], state["retire"])):
            return
        events, gaps, notices = [], [], []
        for upcoming, (_, at) in sorted(waiting.items()):
            if upcoming < state["next"]:
                continue
            if at > now:
                break
            if state["first"] is not None:
                gaps.append((state["next"], upcoming - 1))
            state["next"] = upcoming
            events += self._drain(state, waiting)
        self._settle(key, state, [at for _, at in waiting.values()], notices, now)
        if not waiting and state["latest"] <= now:
            whole = state["next"] >= (int(key[1]) + 1) * self.block
            if whole or (state["retire"] is not None and state["retire"] <= now):
                # Copies of its events are behind the watermark, which drops them; the tenant's step knows how far it came.
                self.state.clear()
                self.held.clear()
            else:
                if state["retire"] is None or state["retire"] < state["latest"] + KEEP_MS:
                    state["retire"] = state["latest"] + KEEP_MS
                    self.handle.registerTimer(state["retire"])
                self._write(state, waiting)
        else:
            self._write(state, waiting)
        if events or gaps or notices:
            yield self._rows(key, timerValues, state, events, gaps, notices)

    def close(self) -> None:
        pass


class _TenantGaps(StatefulProcessor):
    """The ranges between a tenant's blocks, from one notice for each block that opens or closes; all else passes through.

    Blocks are taken in order up to the first that is open. What lies between the number reached so far and the first
    one of a closed block is missing: one range, however many blocks are empty.
    """

    def __init__(self, cursor: int):
        self.cursor = cursor

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.reached = handle.getValueState("reached", _NUMBER)
        self.blocks = handle.getMapState("blocks", _NUMBER, _TEXT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        names = STREAM_SCHEMA.fieldNames()
        if int(key[1]) != _NOTICES:
            for batch in rows:
                yield batch[names]
            return
        for batch in rows:
            for block, kind, first, upto, version in zip(*[batch[c] for c in ("seq", "kind", "id", "gap_end", "version")]):
                known = json.loads(self.blocks.getValue((int(block),))[0]) if self.blocks.containsKey((int(block),)) else None
                if known is None or known["version"] < version:
                    told = {"version": int(version), "open": kind == "open", "first": None if pd.isna(first) else int(first), "next": int(upto)}
                    self.blocks.updateValue((int(block),), (json.dumps(told),))
        reached, gaps = self.reached.get()[0] if self.reached.exists() else self.cursor + 1, []
        for block in sorted(k[0] for k in self.blocks.keys()):
            told = json.loads(self.blocks.getValue((block,))[0])
            if told["open"]:
                break
            if told["first"] is not None and told["first"] > reached:
                gaps.append((key[0], reached, None, "gap", told["first"] - 1))
            reached = max(reached, told["next"])
            self.blocks.removeKey((block,))
        self.reached.update((reached,))
        if gaps:
            yield pd.DataFrame(gaps, columns=names).astype({c: "Int64" for c in ("seq", "id", "gap_end")})

    def close(self) -> None:
        pass


def audit_stream(stream: DataFrame, cursor: int = 0, block: int = SEQ_BLOCK, wait: str = "10 minutes") -> DataFrame:
    """A tenant's events after a cursor in sequence order, and every missing range once and in whole (kind gap, seq to gap_end).

    `stream`: tenant_id, seq, id, ts. Each tenant is cut into blocks of sequence numbers, so a busy tenant spreads
    over all tasks; a block reports holes between its own events. One notice for each block that opens or closes goes on to
    a second step per tenant, which reports what is missing between blocks, whole empty ones included. A number counts
    as missing once a later one has waited for `wait`. Nothing is known about numbers behind a tenant's last event.
    """
    after = stream.filter(F.col("seq") > cursor).select("tenant_id", "seq", "id", F.col("ts").cast("timestamp").alias("ts"))
    sent = after.withWatermark("ts", wait).select(
        "tenant_id", F.floor(F.col("seq") / block).alias("block"), "seq", "id", F.unix_millis("ts").alias("at_ms"), "ts"
    )
    steps = sent.groupBy("tenant_id", "block").transformWithStateInPandas(
        _OrderedBlock(block, cursor), _STEP_SCHEMA, "Append", "EventTime", eventTimeColumnName="at"
    )
    return steps.groupBy("tenant_id", "lane").transformWithStateInPandas(_TenantGaps(cursor), STREAM_SCHEMA, "Append", "EventTime")


def sequence_gaps(df: DataFrame, cursor: int = 0, block: int = SEQ_BLOCK, latest: DataFrame | None = None) -> DataFrame:
    """Batch twin of the gap rows: missing ranges after a cursor, per tenant.

    `latest` (tenant_id, seq) pins the committed tail: numbers up to it that are missing at the end are a range too.
    """
    after = df.filter(F.col("seq") > cursor).select("tenant_id", "seq")
    if latest is not None:
        # One row behind the tail bounds the last range; it is no event itself.
        after = after.unionByName(latest.filter(F.col("seq") > cursor).select("tenant_id", (F.col("seq") + 1).alias("seq")))
    stepped = previous(after, ["tenant_id"], ["seq"], F.floor(F.col("seq") / block), ["seq"])
    before = F.coalesce("prev_seq", F.lit(cursor))
    return stepped.filter(F.col("seq") > before + 1).select(
        "tenant_id", (before + 1).alias("seq"), (F.col("seq") - 1).alias("gap_end")
    )


def stream_after(df: DataFrame, cursor: int, limit: int = 1000, latest: DataFrame | None = None) -> DataFrame:
    """One page strictly after a cursor, up to the first gap (batch pull of the same stream).

    Reads the page's own numbers only. With `latest` (tenant_id, seq) every row says whether its page is `consistent`:
    whole, or cut by nothing but the committed tail; a tenant whose first number is missing has a row without seq.
    """
    page = df.filter((F.col("seq") > cursor) & (F.col("seq") <= cursor + limit))
    stop = sequence_gaps(page, cursor).groupBy("tenant_id").agg(F.min("seq").alias("stop"))
    found = join_same(page, stop, ["tenant_id"], "left").filter(F.col("stop").isNull() | (F.col("seq") < F.col("stop"))).drop("stop")
    if latest is None:
        return found
    reached = found.groupBy("tenant_id").agg(F.max("seq").alias("__upto"))
    tail = latest.select("tenant_id", F.col("seq").alias("__tail")).filter(F.col("__tail") > cursor)
    checked = join_same(tail, reached, ["tenant_id"], "left").select(
        "tenant_id", (F.coalesce("__upto", F.lit(cursor)) >= F.least("__tail", F.lit(cursor + limit))).alias("consistent")
    )
    return join_same(checked, found, ["tenant_id"], "left").select(*found.columns, "consistent")


LIMIT_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("agent_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("limit_reason", T.StringType()),
    ]
)


class _TokenBuckets(_Resumable):
    """One agent's bucket. With `idle` its state ends, by event time, once the bucket is as a new one."""

    def __init__(self, qps: float, max_concurrent: int, sort_rows: int, columns: list[str], idle: bool):
        self.qps, self.max_concurrent, self.sort_rows, self.columns, self.idle = qps, max_concurrent, sort_rows, columns, idle

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        bucket = TokenBucket(self.qps, self.max_concurrent, self.state.read())
        for batch in _in_order(rows, self.sort_rows):
            reasons = []
            for at, ms, qps, most in zip(batch["at_s"], batch["latency_ms"], batch["qps"], batch["max_concurrent"]):
                late = bucket.last is not None and at < bucket.last
                reasons.append("late" if late else bucket.offer(at, ms / 1000.0, qps, most))
            out = batch[self.columns].copy()
            out["limit_reason"] = reasons
            yield out
        self.state.write(bucket.state())
        if self.idle:
            self._wait(bucket, timerValues)

    def _wait(self, bucket: TokenBucket, timerValues) -> None:
        full = bucket.full_at()
        if full is not None and full != float("inf"):
            self.handle.registerTimer(max(int(full * 1000) + 1, timerValues.getCurrentWatermarkInMs() + 1))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.read()
        if state:
            full = TokenBucket(self.qps, self.max_concurrent, state).full_at()
            # A timer of an earlier, shorter wait finds the bucket still in use; its own later timer is set.
            if full is not None and full * 1000 < timerValues.getCurrentWatermarkInMs():
                self.state.clear()
        return iter(())


def rate_limit(
    stream: DataFrame, qps: float = DEFAULTS["qps_per_agent"], max_concurrent: int = DEFAULTS["max_conns_per_datasource"], sort_rows: int = SORT_ROWS,
    delay: str | None = None, carried: Column | None = None, states: DataFrame | None = None,
) -> DataFrame:
    """Live token bucket per agent in event-time order; a row behind its bucket's clock is marked late.

    Where the stream has a `config` (see risk.resolve_config), the thresholds of rule R008 in it hold for the row. With
    `delay` rows further behind the newest event are left to `runtime.split_late`, and a bucket that has refilled and
    freed its slots is forgotten, which changes no result. `carried` is a text that goes along in place of the id.
    The batch twin is `operators.risk.rate_limits`; with `states` (see risk.rate_limit_states) the stream goes on from there.
    """
    if delay is not None:
        stream = stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    columns = ["tenant_id", "agent_id", "id"] if carried is None else ["carried"]
    schema = LIMIT_SCHEMA if carried is None else T.StructType([T.StructField("carried", T.StringType()), LIMIT_SCHEMA["limit_reason"]])
    slim = limit_rows(stream, qps, max_concurrent, *([] if carried is None else [carried.alias("carried")]))
    slim = slim if delay is not None else slim.drop("ts")
    return slim.groupBy("tenant_id", "agent_id").transformWithStateInPandas(
        _TokenBuckets(qps, max_concurrent, sort_rows, columns, delay is not None), schema, "Append", "None" if delay is None else "EventTime",
        _started(states, "tenant_id", "agent_id"),
    )


# Attempts per window and its length in seconds.
MAX_ATTEMPTS, ATTEMPT_WINDOW_S = 10, 60
ATTEMPT_SCHEMA = T.StructType(
    [
        T.StructField("tenant_key", T.StringType()),
        T.StructField("user_key", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("allowed", T.BooleanType()),
    ]
)


def _attempts(times: list[float], state: dict | None, limit: int, window_s: float) -> tuple[list[bool], dict]:
    """A window starts at its first attempt; refused attempts do not extend it. One without a time is refused."""
    started, count = (state["started"], state["count"]) if state else (None, 0)
    allowed = []
    for at in times:
        if at != at:
            allowed.append(False)
            continue
        if started is None or at - started >= window_s:
            started, count = at, 0
        ok = count < limit
        count += ok
        allowed.append(ok)
    return allowed, {"started": started, "count": int(count)}


class _AttemptWindows(_Resumable):
    def __init__(self, limit: int, window_s: float, sort_rows: int):
        self.limit, self.window_s, self.sort_rows = limit, window_s, sort_rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.read()
        for batch in _in_order(rows, self.sort_rows):
            allowed, state = _attempts(batch["at_s"].tolist(), state, self.limit, self.window_s)
            out = batch[["tenant_key", "user_key", "id"]].copy()
            out["allowed"] = allowed
            yield out
        self.state.write(state)
        # The state is of no use once its window has passed in event time.
        if state["started"] is not None:
            self.handle.registerTimer(int((state["started"] + self.window_s) * 1000))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state = self.state.read()
        if state and state["started"] is not None and (state["started"] + self.window_s) * 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter(())


def _attempt_rows(df: DataFrame, user: str) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return df.select(
        F.lower(F.trim("tenant_id")).alias("tenant_key"), F.lower(F.trim(user)).alias("user_key"), "id", at.alias("at_s"),
        F.col("ts").cast("timestamp").alias("ts"),
    ).filter((F.col("tenant_key") != "") & (F.col("user_key") != ""))


def attempt_limit(
    stream: DataFrame, user: str, limit: int = MAX_ATTEMPTS, window_s: float = ATTEMPT_WINDOW_S, delay: str = "10 minutes", sort_rows: int = SORT_ROWS,
    states: DataFrame | None = None,
) -> DataFrame:
    """Live attempt budget per tenant and user, in windows that start at the first attempt.

    Rows further behind the newest one than `delay` are dropped; `runtime.split_late` before it keeps them apart. With
    `states` (see attempt_limit_states) the stream goes on where a batch run ended.
    """
    rows = _attempt_rows(stream, user).withWatermark("ts", delay)
    return rows.groupBy("tenant_key", "user_key").transformWithStateInPandas(
        _AttemptWindows(limit, window_s, sort_rows), ATTEMPT_SCHEMA, "Append", "EventTime", _started(states, "tenant_key", "user_key")
    )


def attempt_limits(df: DataFrame, user: str, limit: int = MAX_ATTEMPTS, window_s: float = ATTEMPT_WINDOW_S, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Batch twin of `attempt_limit`, folding each user in time order and in bounded blocks."""
    return ordered_fold(*_attempt_fold(df, user, limit, window_s), max_block_rows)


def attempt_limit_states(df: DataFrame, user: str, limit: int = MAX_ATTEMPTS, window_s: float = ATTEMPT_WINDOW_S, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """tenant_key, user_key and the window's `state` after the log."""
    return ordered_states(*_attempt_fold(df, user, limit, window_s), max_block_rows)


def _attempt_fold(df: DataFrame, user: str, limit: int, window_s: float) -> tuple:
    def step(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        allowed, state = _attempts(rows["at_s"].tolist(), state, limit, window_s)
        out = rows[["tenant_key", "user_key", "id"]].copy()
        out["allowed"] = allowed
        return out, state

    return _attempt_rows(df, user), ["tenant_key", "user_key"], ["ts", "id"], time_slice("ts"), step, ATTEMPT_SCHEMA


# Seconds until the next attempt, by attempts made.
RETRY_DELAYS_S = (10, 30, 60, 300, 900)
DELIVERY_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("channel_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("applied", T.BooleanType()),
        T.StructField("last_seq", T.LongType()),
        T.StructField("failures", T.LongType()),
        T.StructField("dead_letter", T.BooleanType()),
        T.StructField("retry_after_s", T.DoubleType()),
    ]
)


def retry_delay(attempts: int) -> int:
    return RETRY_DELAYS_S[min(max(attempts, 0), len(RETRY_DELAYS_S) - 1)]


class DeliveryCursor:
    """Delivery state of one channel: claims lease the next number to one worker, its ack moves exactly one.

    An action without a time, or one that needs a number and has none, is not applied.
    """

    def __init__(self, state: dict | None, max_failures: int, lease_s: float):
        fresh = {"last_seq": 0, "failures": 0, "dead": False, "retry_after": 0.0, "lease_until": 0.0, "token": ""}
        self.s, self.max_failures, self.lease_s = {**fresh, **(state or {})}, max_failures, lease_s

    def apply(self, action: str, seq: float, at: float, token: str) -> bool:
        s = self.s
        if at != at:
            return False
        leased = s["lease_until"] > at
        # Only the worker that holds the lease may end it: its token was set by its own claim.
        owned = leased and token != "" and token == s["token"]
        if action == "claim":
            ok = token != "" and not s["dead"] and s["retry_after"] <= at and not leased
            if ok:
                s.update(lease_until=at + self.lease_s, token=token)
        elif action == "ack":
            ok = owned and seq == s["last_seq"] + 1
            if ok:
                s.update(last_seq=int(seq), failures=0, retry_after=0.0, lease_until=0.0, token="")
        elif action == "release":
            ok = owned
            if ok:
                s.update(lease_until=0.0, token="")
        elif action == "fail":
            ok = owned
            if ok:
                s.update(retry_after=at + retry_delay(s["failures"]), failures=s["failures"] + 1, lease_until=0.0, token="")
                s["dead"] = s["failures"] >= self.max_failures
        elif action == "replay":
            ok = s["dead"]
            if ok:
                s.update(dead=False, failures=0, retry_after=0.0, lease_until=0.0, token="")
        else:
            ok = False
        return ok


def _deliver(rows: pd.DataFrame, state: dict | None, max_failures: int, lease_s: float) -> tuple[pd.DataFrame, dict]:
    cursor = DeliveryCursor(state, max_failures, lease_s)
    out = []
    for tenant, channel, row_id, action, seq, at, token in zip(
        rows["tenant_id"], rows["channel_id"], rows["id"], rows["action"], rows["seq"], rows["at_s"], rows["token"]
    ):
        applied = cursor.apply(action, seq, float(at), token)
        s = cursor.s
        out.append((tenant, channel, row_id, applied, s["last_seq"], s["failures"], s["dead"], s["retry_after"]))
    return pd.DataFrame(out, columns=DELIVERY_SCHEMA.fieldNames()), cursor.s


class _Deliveries(_Resumable):
    def __init__(self, max_failures: int, lease_s: float, sort_rows: int):
        self.max_failures, self.lease_s, self.sort_rows = max_failures, lease_s, sort_rows

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        state = self.state.read()
        for batch in _in_order(rows, self.sort_rows):
            out, state = _deliver(batch, state, self.max_failures, self.lease_s)
            yield out
        self.state.write(state)


def _delivery_rows(df: DataFrame) -> DataFrame:
    at = F.unix_micros(F.col("ts").cast("timestamp")).cast("double") / 1e6
    return df.select("tenant_id", "channel_id", "id", "action", "seq", F.coalesce("token", F.lit("")).alias("token"), "ts", at.alias("at_s"))


def delivery_state(
    stream: DataFrame, max_failures: int = 5, lease_s: float = 60.0, sort_rows: int = SORT_ROWS, states: DataFrame | None = None
) -> DataFrame:
    """Live delivery cursors: tenant_id, channel_id, id, action (claim, ack, release, fail, replay), seq, token, ts.

    A claim sets its token; an ack, release or fail counts only with the token of the lease that still runs. A channel's
    cursor is kept for good. With `states` (see delivery_cursors) the stream goes on where a batch run ended.
    """
    rows = _delivery_rows(stream).drop("ts")
    return rows.groupBy("tenant_id", "channel_id").transformWithStateInPandas(
        _Deliveries(max_failures, lease_s, sort_rows), DELIVERY_SCHEMA, "Append", "None", _started(states, "tenant_id", "channel_id")
    )


def delivery_states(df: DataFrame, max_failures: int = 5, lease_s: float = 60.0, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Batch twin of `delivery_state`."""
    return ordered_fold(*_delivery_fold(df, max_failures, lease_s), max_block_rows)


def delivery_cursors(df: DataFrame, max_failures: int = 5, lease_s: float = 60.0, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """tenant_id, channel_id and the cursor's `state` after the log."""
    return ordered_states(*_delivery_fold(df, max_failures, lease_s), max_block_rows)


def _delivery_fold(df: DataFrame, max_failures: int, lease_s: float) -> tuple:
    def step(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        return _deliver(rows, state, max_failures, lease_s)

    return _delivery_rows(df), ["tenant_id", "channel_id"], ["ts", "id"], time_slice("ts"), step, DELIVERY_SCHEMA


HISTORY, SALTS = 200, 16
HISTORY_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("salt", T.IntegerType()),
        T.StructField("version", T.LongType()),
        T.StructField("seq", T.LongType()),
        T.StructField("id", T.LongType()),
    ]
)


class _Rings(StatefulProcessor):
    """The last n events of one salt of a tenant, given out anew after every change."""

    def __init__(self, size: int):
        self.size = size

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", T.StructType([T.StructField("seq", T.LongType()), T.StructField("id", T.LongType())]))
        self.version = handle.getValueState("version", T.StructType([T.StructField("n", T.LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = [(int(s), int(i)) for s, i in self.ring.get()] if self.ring.exists() else []
        for batch in rows:
            held += list(zip(batch["seq"].tolist(), batch["id"].tolist()))
            held = sorted(held)[-self.size :]
        version = (self.version.get()[0] if self.version.exists() else 0) + 1
        self.ring.put(held)
        self.version.update((version,))
        out = pd.DataFrame(held, columns=["seq", "id"])
        out["tenant_id"], out["salt"], out["version"] = key[0], int(key[1]), version
        yield out[HISTORY_SCHEMA.fieldNames()].astype({"salt": "int32"})

    def close(self) -> None:
        pass


def recent_stream(stream: DataFrame, n: int = HISTORY, salts: int = SALTS) -> DataFrame:
    """Rolling history per tenant and salt, so that a busy tenant is kept by many tasks."""
    salted = stream.select("tenant_id", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"), "seq", "id")
    return salted.groupBy("tenant_id", "salt").transformWithStateInPandas(_Rings(n), HISTORY_SCHEMA, "Append", "None")


def recent_of(rings: DataFrame, n: int = HISTORY) -> DataFrame:
    """The tenant's last n events from the newest version of each of its rings."""
    newest = rings.groupBy("tenant_id", "salt").agg(F.max("version").alias("version"))
    return recent(join_same(rings, newest, ["tenant_id", "salt", "version"]).select("tenant_id", "seq", "id"), n)


def recent(df: DataFrame, n: int = HISTORY) -> DataFrame:
    """The last n events per tenant; each task passes on at most n rows per tenant."""
    order = Window.partitionBy("tenant_id").orderBy(F.desc("seq"))
    return df.withColumn("__rank", F.row_number().over(order)).filter(F.col("__rank") <= n).drop("__rank")


LATE_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("late", T.BooleanType()),
    ]
)


class _LateRows(StatefulProcessor):
    def __init__(self, delay_s: float):
        self.delay_s = delay_s

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = _JsonState(handle)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = newest = (self.state.read() or {"max": float("-inf")})["max"]
        for batch in rows:
            out = batch[["tenant_id", "id", "ts"]].copy()
            out["late"] = batch["at_s"] < seen - self.delay_s
            newest = max(newest, float(batch["at_s"].max()))
            yield out
        self.state.write({"max": newest})

    def close(self) -> None:
        pass


def flag_late(stream: DataFrame, delay_s: float, salts: int = SALTS) -> DataFrame:
    """Rows marked late against the newest event time of earlier micro-batches, for a side table.

    Salted like the history, so each task compares with its own share of the tenant's events.
    """
    stamped = F.col("ts").cast("timestamp")
    salted = stream.select(
        "tenant_id", "id", stamped.alias("ts"), (F.unix_micros(stamped).cast("double") / 1e6).alias("at_s"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
    )
    return salted.groupBy("tenant_id", "salt").transformWithStateInPandas(_LateRows(delay_s), LATE_SCHEMA, "Append", "None")
