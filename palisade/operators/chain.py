"""Tamper evidence: canonical rows, chained hashes, verification, checkpoints and key drift."""

from __future__ import annotations

import hashlib
import hmac
import struct
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palisade.functions.folds import MAX_BLOCK_ROWS, ordered_fold
from palisade.functions.hashing import hmac_sha256_hex, tlv_bytes, tlv_int, tlv_text
from palisade.functions.segments import join_same, previous

# Canonical fields in order; the integer ones are framed as integers.
CANONICAL_FIELDS = (
    "id", "ts", "agent_id", "datasource_id", "session_id", "conversation_id", "mcp_tool", "db_type", "sql_raw",
    "sql_norm", "stmt_type", "objects", "decision", "rule_hits", "risk_level", "est_rows", "rows_returned",
    "latency_ms", "client_ip", "model_name", "error_msg", "error_code", "action", "actor_type", "actor_id",
    "details_json", "event_uuid",
)
INTEGER_FIELDS = ("id", "risk_level", "est_rows", "rows_returned", "latency_ms")
SHA256, HMAC_SHA256 = "sha256", "hmac-sha256"
FORMAT_VERSION = 1
KEYS = ["tenant_id", "chain_id"]
HASH_TEXT = r"^[0-9a-f]{64}$"


@dataclass(frozen=True)
class ChainConfig:
    """Domain tag, genesis text, instance and key of a family of chains."""

    instance_id: str
    domain: str = "palisade-audit-chain-v1"
    genesis: str = "PALISADE_AUDIT_CHAIN_GENESIS_V1"
    key: bytes | None = None
    key_version: int = 0

    def __post_init__(self) -> None:
        if (self.key is None) != (self.key_version == 0):
            raise ValueError("a key needs a positive version, and no key means version 0")

    @property
    def mode(self) -> str:
        return SHA256 if self.key is None else HMAC_SHA256

    @property
    def mode_name(self) -> str:
        return "keyless" if self.key is None else "hmac"

    @property
    def genesis_hex(self) -> str:
        return hashlib.sha256(self.genesis.encode()).hexdigest()


def chain_timestamp(ts: Column) -> Column:
    """UTC with exactly six fraction digits."""
    return F.date_format(ts.cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def canonical_bytes(df: DataFrame) -> Column:
    """The framed canonical fields; missing columns count as NULL."""
    parts = []
    for name in CANONICAL_FIELDS:
        if name == "ts":
            parts.append(tlv_text(chain_timestamp(F.col("ts"))))
        elif name not in df.columns:
            parts.append(F.unhex(F.lit("0000000000")))
        elif name in INTEGER_FIELDS:
            parts.append(tlv_int(name))
        else:
            parts.append(tlv_text(name))
    return F.concat(*parts)


def envelope_hash(
    canonical: Column, chain_id: Column, seq: Column, prev_hash: Column, config: ChainConfig, key_version: Column | None = None
) -> Column:
    """The chained hash of a row, from its own stored predecessor hash."""
    encoded = F.concat(
        tlv_text(F.lit(config.domain)),
        tlv_text(F.lit(config.instance_id)),
        tlv_text(chain_id),
        tlv_int(F.lit(FORMAT_VERSION)),
        tlv_text(F.lit(config.mode)),
        tlv_int(F.lit(config.key_version) if key_version is None else key_version),
        tlv_int(seq),
        tlv_bytes(F.unhex(prev_hash)),
        tlv_bytes(canonical),
    )
    return F.sha2(encoded, 256) if config.key is None else hmac_sha256_hex(config.key, encoded)


def _frame(tag: int, payload: bytes) -> bytes:
    return struct.pack(">BI", tag, len(payload)) + payload


def _chain_step(config: ChainConfig):
    """Link one chain's rows; only the hash itself runs here, framing of the row is done before."""
    domain, instance, mode, key = config.domain.encode(), config.instance_id.encode(), config.mode.encode(), config.key
    version, genesis = config.key_version, config.genesis_hex

    def step(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        seq, prev = (state["seq"], state["hash"]) if state else (0, genesis)
        name = rows["chain_id"].iloc[0]
        chain = _frame(0, b"") if pd.isna(name) else _frame(1, str(name).encode())
        head = (
            _frame(1, domain) + _frame(1, instance) + chain
            + _frame(2, str(FORMAT_VERSION).encode()) + _frame(1, mode) + _frame(2, str(version).encode())
        )
        seqs, prevs, selves = [], [], []
        for canonical in rows["canonical"]:
            seq += 1
            message = head + _frame(2, str(seq).encode()) + _frame(3, bytes.fromhex(prev)) + _frame(3, bytes(canonical))
            own = hashlib.sha256(message).hexdigest() if key is None else hmac.new(key, message, hashlib.sha256).hexdigest()
            seqs.append(seq)
            prevs.append(prev)
            selves.append(own)
            prev = own
        out = rows[["tenant_id", "chain_id", "id"]].copy()
        out["chain_seq"], out["prev_hash"], out["self_hash"] = seqs, prevs, selves
        return out, {"seq": seq, "hash": prev}

    return step


CHAIN_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("chain_id", T.StringType()),
        T.StructField("id", T.LongType()),
        T.StructField("chain_seq", T.LongType()),
        T.StructField("prev_hash", T.StringType()),
        T.StructField("self_hash", T.StringType()),
    ]
)


def build_chain(df: DataFrame, config: ChainConfig, max_block_rows: int = MAX_BLOCK_ROWS) -> DataFrame:
    """Link rows per (tenant, chain) in id order, from genesis.

    A chain is sequential by nature: each hash needs the one before. Chains run side by side, and
    a long chain runs in bounded blocks that hand over only their last hash.
    """
    framed = df.select(*KEYS, "id", canonical_bytes(df).alias("canonical"))
    block = F.floor(F.col("id") / max_block_rows)
    linked = ordered_fold(framed, KEYS, ["id"], block, _chain_step(config), CHAIN_SCHEMA, max_block_rows)
    return linked.withColumns(
        {"chain_key_version": F.lit(config.key_version), "chain_format_version": F.lit(FORMAT_VERSION)}
    )


def chain_state(chained: DataFrame, config: ChainConfig) -> DataFrame:
    """Head of each chain, as a writer would keep it."""
    return chained.groupBy(*KEYS).agg(
        F.max("chain_seq").alias("head_seq"),
        F.max_by("id", "chain_seq").alias("head_id"),
        F.max_by("self_hash", "chain_seq").alias("head_hash"),
    ).withColumns({"status": F.lit("ACTIVE"), "mode": F.lit(config.mode_name)})


# Break reasons in the order they are checked, and the other outcomes.
HALF_CHAINED, DUPLICATE, GAP = "half_chained", "seq_duplicate", "seq_gap"
BAD_FORMAT, PREV_MISMATCH, MODE_DOWNGRADE = "bad_format", "prev_mismatch", "mode_downgrade"
SELF_MISMATCH, HEAD_MISMATCH, KEY_UNAVAILABLE = "self_mismatch", "head_mismatch", "key_unavailable"
VALID, INCOMPLETE, DISABLED, FAILED = "VALID_AT_OBSERVED_HEAD", "coverage_incomplete", "disabled", "failed"
BREAKS = (HALF_CHAINED, DUPLICATE, GAP, BAD_FORMAT, PREV_MISMATCH, MODE_DOWNGRADE, SELF_MISMATCH, HEAD_MISMATCH)
SEQ_BLOCK = 100_000


def verify_chain(df: DataFrame, state: DataFrame, config: ChainConfig, seq_block: int = SEQ_BLOCK) -> DataFrame:
    """One outcome per chain: VALID, or the first break in (sequence, id) order, or a coverage class.

    Every row is checked on its own: its hash from its own stored predecessor hash, and its
    link against the row before it. Rows meet their predecessors inside blocks of sequence
    numbers, and blocks through one last row each, so a single huge chain spreads over all tasks.
    """
    chain_columns = ["chain_seq", "prev_hash", "self_hash", "chain_key_version", "chain_format_version"]
    filled = sum((F.col(c).isNotNull().cast("int") for c in chain_columns), start=F.lit(0))
    own = envelope_hash(
        canonical_bytes(df), F.col("chain_id"), F.col("chain_seq"), F.col("prev_hash"), config, F.col("chain_key_version")
    )
    # The row's text is hashed before the shuffle; only digests and flags travel.
    slim = df.select(
        *KEYS, "id", "chain_seq", "prev_hash", "self_hash",
        filled.alias("filled"),
        F.coalesce(
            (F.col("chain_format_version") == FORMAT_VERSION) & F.col("prev_hash").rlike(HASH_TEXT) & F.col("self_hash").rlike(HASH_TEXT),
            F.lit(False),
        ).alias("format_ok"),
        F.coalesce(F.col("chain_key_version") == config.key_version, F.lit(False)).alias("mode_ok"),
        F.coalesce(own == F.col("self_hash"), F.lit(False)).alias("self_ok"),
    )
    coverage = slim.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("total_rows"),
        F.count_if(F.col("chain_seq").isNull()).alias("unchained"),
        F.count("chain_seq").alias("linked"),
        F.min(
            F.when(~F.col("filled").isin(0, len(chain_columns)), F.struct(F.coalesce("chain_seq", F.lit(0)).alias("seq"), F.col("id")))
        ).alias("half"),
        F.max(F.when(F.col("chain_seq").isNotNull(), F.struct("chain_seq", "id", "self_hash"))).alias("last"),
    )
    linked = slim.filter(F.col("chain_seq").isNotNull()).drop("filled")
    stepped = previous(linked, KEYS, ["chain_seq", "id"], F.floor(F.col("chain_seq") / seq_block), ["chain_seq", "self_hash"])
    expected = F.coalesce(F.col("prev_chain_seq") + 1, F.lit(1).cast("bigint"))
    reason = (
        F.when(F.col("chain_seq") < expected, DUPLICATE)
        .when(F.col("chain_seq") > expected, GAP)
        .when(~F.col("format_ok"), BAD_FORMAT)
        .when(F.col("prev_hash") != F.coalesce("prev_self_hash", F.lit(config.genesis_hex)), PREV_MISMATCH)
        .when(~F.col("mode_ok"), MODE_DOWNGRADE)
        .when(~F.col("self_ok"), SELF_MISMATCH)
    )
    reported = F.when(F.col("chain_seq") > expected, expected).otherwise(F.col("chain_seq"))
    breaks = (
        stepped.withColumn("reason", reason)
        .filter(F.col("reason").isNotNull())
        .groupBy(*KEYS)
        .agg(F.min_by(F.struct("reason", reported.alias("seq"), "id"), F.struct("chain_seq", "id")).alias("b"))
    )
    joined = join_same(join_same(state, coverage, KEYS, "left"), breaks, KEYS, "left")
    head_ok = (
        (F.col("head_seq") == F.coalesce("linked", F.lit(0)))
        & (F.coalesce("last.chain_seq", F.lit(0)) == F.col("head_seq"))
        & ((F.col("head_seq") == 0) | ((F.col("last.id") == F.col("head_id")) & (F.col("last.self_hash") == F.col("head_hash"))))
    )
    half, broken = F.col("half").isNotNull(), F.col("b").isNotNull()
    off, bad_head = F.col("status").isin("DISABLED", "FAILED"), ~F.coalesce(head_ok, F.lit(False))
    wrong_mode = F.col("mode") != config.mode_name
    outcome = (
        F.when(off, F.lower("status"))
        .when(wrong_mode, MODE_DOWNGRADE)
        .when(half, HALF_CHAINED)
        .when(broken, F.col("b.reason"))
        .when(bad_head, HEAD_MISMATCH)
        .when((F.coalesce("unchained", F.lit(0)) > 0) | (F.col("status") != "ACTIVE"), INCOMPLETE)
        .otherwise(VALID)
    )
    break_seq = F.when(off, None).when(wrong_mode, 0).when(half, F.col("half.seq")).when(broken, F.col("b.seq")).when(bad_head, F.col("head_seq"))
    break_id = F.when(off, None).when(wrong_mode, 0).when(half, F.col("half.id")).when(broken, F.col("b.id")).when(
        bad_head, F.coalesce("head_id", "last.id", F.lit(0))
    )
    code = F.when(outcome == VALID, 0).when(outcome.isin(DISABLED, FAILED, INCOMPLETE), 4).otherwise(2)
    return joined.select(
        *KEYS,
        outcome.alias("outcome"),
        break_seq.cast("bigint").alias("break_seq"),
        break_id.cast("bigint").alias("break_id"),
        F.coalesce("total_rows", F.lit(0)).alias("total_rows"),
        F.coalesce("unchained", F.lit(0)).alias("unchained"),
        code.alias("code"),
    )


def exit_class(outcome: str, key_available: bool = True, runtime_error: bool = False) -> int:
    """Process code of an outcome: 0 valid, 2 break, 3 no key, 4 not covered, 5 runtime error."""
    if outcome == VALID:
        return 0
    if not key_available or outcome == KEY_UNAVAILABLE:
        return 3
    if runtime_error:
        return 5
    if outcome in (DISABLED, FAILED, INCOMPLETE):
        return 4
    return 2 if outcome in BREAKS else 5


CHECKPOINT_FIELDS = ("chain_id", "archive_sha256", "created_at", "signed_at", "head_seq", "head_hash", "previous_sha256")


def checkpoint_digest() -> Column:
    return F.sha2(F.concat(*_checkpoint_parts()), 256)


def _checkpoint_parts() -> list[Column]:
    parts = []
    for name in CHECKPOINT_FIELDS:
        if name in ("created_at", "signed_at"):
            parts.append(tlv_text(chain_timestamp(F.col(name))))
        elif name == "head_seq":
            parts.append(tlv_int(name))
        else:
            parts.append(tlv_text(name))
    return parts


# Checkpoints of a chain that one task links: their framed texts are about 120 bytes each when shuffled.
LINK_BLOCK_ROWS = 2_000_000
LINK_SCHEMA = T.StructType(
    [
        T.StructField("tenant_id", T.StringType()),
        T.StructField("chain_id", T.StringType()),
        T.StructField("ordinal", T.LongType()),
        T.StructField("previous_sha256", T.StringType()),
    ]
)


def link_checkpoints(checkpoints: DataFrame, max_block_rows: int = LINK_BLOCK_ROWS) -> DataFrame:
    """Adds each checkpoint's `previous_sha256`, the digest of the one before it, by place; the first has none.

    A digest covers the link itself, which is its last field, so everything before it is framed beforehand and
    only the hashes run one after the other.
    """
    head = F.concat(*_checkpoint_parts()[:-1])
    framed = checkpoints.select(*KEYS, F.col("ordinal").cast("bigint").alias("ordinal"), head.alias("head"))

    def step(rows: pd.DataFrame, state: dict | None) -> tuple[pd.DataFrame, dict]:
        digest, links = state["digest"] if state else None, []
        for prefix in rows["head"]:
            links.append(digest)
            digest = hashlib.sha256(bytes(prefix) + (_frame(0, b"") if digest is None else _frame(1, digest.encode()))).hexdigest()
        out = rows[["tenant_id", "chain_id", "ordinal"]].copy()
        out["previous_sha256"] = links
        return out, {"digest": digest}

    linked = ordered_fold(framed, KEYS, ["ordinal"], F.floor(F.col("ordinal") / SEQ_BLOCK), step, LINK_SCHEMA, max_block_rows)
    return join_same(checkpoints.drop("previous_sha256"), linked, [*KEYS, "ordinal"])


def verify_checkpoints(checkpoints: DataFrame, block: int = SEQ_BLOCK) -> DataFrame:
    """Checkpoints that break the order, the head or the link to the one before.

    `checkpoints` hold the digest fields, a tenant and `ordinal` (their place in the chain).
    """
    digested = checkpoints.withColumn("digest", checkpoint_digest())
    stepped = previous(
        digested, KEYS, ["ordinal"], F.floor(F.col("ordinal") / block), ["created_at", "signed_at", "head_seq", "head_hash", "digest"]
    )
    seen = F.col("prev_digest").isNotNull()
    problem = (
        F.when(seen & (F.col("created_at") <= F.col("prev_created_at")), "created_not_later")
        .when(seen & (F.col("signed_at") < F.col("prev_signed_at")), "signed_earlier")
        .when(seen & (F.col("head_seq") < F.col("prev_head_seq")), "head_went_back")
        .when(seen & (F.col("head_seq") == F.col("prev_head_seq")) & (F.col("head_hash") != F.col("prev_head_hash")), "head_hash_changed")
        .when(F.coalesce("previous_sha256", F.lit("")) != F.coalesce("prev_digest", F.lit("")), "link_broken")
    )
    return stepped.withColumn("problem", problem).filter(F.col("problem").isNotNull()).select(*KEYS, "ordinal", "problem")


def checkpoint_heads(checkpoints: DataFrame) -> DataFrame:
    """Digest of the newest checkpoint per chain, to compare with the trusted head."""
    digested = checkpoints.withColumn("digest", checkpoint_digest())
    return digested.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.max_by("digest", "ordinal").alias("head_digest"))


def verify_heads(checkpoints: DataFrame, trusted: DataFrame) -> DataFrame:
    """Per chain its length and whether its newest digest is the trusted one (`trusted`: keys, head_digest).

    A trusted chain without any checkpoint is reported too, with length 0.
    """
    known = trusted.select(*KEYS, F.col("head_digest").alias("__trusted"))
    joined = checkpoint_heads(checkpoints).join(known, KEYS, "full")
    ok = F.coalesce(F.col("head_digest") == F.col("__trusted"), F.lit(False))
    return joined.select(*KEYS, F.coalesce("n", F.lit(0)).alias("n"), ok.alias("trusted"))


def key_drift(observed: DataFrame, registry: DataFrame, scope: Sequence[str] = ("instance_id",)) -> DataFrame:
    """Differences between configured keys and the registry, numbered by class; 2 is fatal and hides the rest.

    `observed`: scope, key_id, commitment, active, revision. `registry`: scope, key_id, commitment,
    state, config_revision.
    """
    keys = [*scope, "key_id"]
    o = observed.select(*keys, F.struct("commitment", "active", "revision").alias("o"))
    r = registry.select(*keys, F.struct("commitment", "state", "config_revision").alias("r"))
    # Only scopes that report keys are judged.
    pairs = o.join(r, keys, "full_outer").join(observed.select(*scope).distinct(), list(scope), "left_semi")
    seen, listed = F.col("o").isNotNull(), F.col("r").isNotNull()
    active = F.coalesce(F.col("o.active"), F.lit(False))
    differs = seen & listed & (F.col("o.commitment") != F.col("r.commitment"))
    is_active = F.coalesce(F.col("r.state") == "active", F.lit(False))
    found = F.array_compact(
        F.array(
            *[
                F.when(condition, F.struct(F.lit(number).alias("number"), F.lit(kind).alias("kind")))
                for number, kind, condition in (
                    (2, "active_commitment_mismatch", active & differs),
                    (2, "retired_key_reuse", seen & F.coalesce(F.col("r.state") == "retired", F.lit(False))),
                    (3, "active_not_registered", active & ~is_active),
                    (4, "configured_commitment_mismatch", ~active & differs),
                    (5, "standby_unregistered", seen & ~active & ~listed),
                    (6, "extra_registered", ~seen & listed),
                    (7, "revision_mismatch", active & is_active & ~differs & (F.col("o.revision") != F.col("r.config_revision"))),
                )
            ]
        )
    )
    rows = pairs.select(*keys, F.inline(found))
    fatal = rows.filter(F.col("number") == 2).select(*scope).distinct()
    return rows.filter(F.col("number") == 2).unionByName(rows.join(fatal, list(scope), "left_anti"))


def sequence_audit(chained: DataFrame) -> DataFrame:
    """Rows, distinct numbers, bounds and missing numbers per chain.

    Distinct numbers are counted from grouped (chain, number) rows, so no set is held in memory.
    """
    per_number = chained.groupBy(*KEYS, "chain_seq").agg(F.count(F.lit(1)).alias("n"))
    return per_number.groupBy(*KEYS).agg(
        F.sum("n").alias("rows"),
        F.count("chain_seq").alias("distinct_seq"),
        F.min("chain_seq").alias("min_seq"),
        F.max("chain_seq").alias("max_seq"),
        F.coalesce(F.sum(F.when(F.col("chain_seq").isNull(), F.col("n"))), F.lit(0)).alias("null_seq"),
    )


def commitment(material: bytes, domain: bytes = b"palisade:commitment\x00") -> str:
    """Public commitment of key material for a key registry."""
    return hashlib.sha256(domain + material).hexdigest()

