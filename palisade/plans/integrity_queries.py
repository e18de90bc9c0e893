"""Hash chains over the audit log: build, verify intact and damaged chains, checkpoints, keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from palisade.operators import chain as c
from palisade.plans.registry import over_audit, query, with_ctes
from palisade.sources import tables as t

CONFIG = c.ChainConfig("11111111-2222-3333-4444-555555555555")
HMAC_CONFIG = c.ChainConfig("11111111-2222-3333-4444-555555555555", key=b"palisade-chain-key-material-0001", key_version=3)


def _framed(tag, text):
    return f"(from_hex('{tag}') || from_hex(lpad(to_hex(octet_length(encode({text}))), 8, '0')) || encode({text}))"


def _field(name):
    if name == "ts":
        return _framed("01", "strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ')")
    if name not in ("id", "agent_id", "datasource_id", "session_id", "stmt_type", "decision", "rule_hits", "est_rows", "latency_ms", "error_code", "event_uuid"):
        return "from_hex('0000000000')"
    tag = "02" if name in c.INTEGER_FIELDS else "01"
    return f"coalesce({_framed(tag, f'{name}::VARCHAR')}, from_hex('0000000000'))"


CANONICAL = " || ".join(_field(n) for n in c.CANONICAL_FIELDS)


def _hash(seq, prev, canonical="canonical", chain="chain_id"):
    fixed = " || ".join(
        [_framed("01", f"'{CONFIG.domain}'"), _framed("01", f"'{CONFIG.instance_id}'"), _framed("01", chain), _framed("02", "'1'"), _framed("01", "'sha256'"), _framed("02", "'0'"), _framed("02", f"{seq}::VARCHAR")]
    )
    return f"sha256({fixed} || from_hex('0300000020') || from_hex({prev}) || from_hex('03') || from_hex(lpad(to_hex(octet_length({canonical})), 8, '0')) || {canonical})"


ROWS = f"""RECURSIVE chain_rows AS (SELECT tenant_id, agent_id AS chain_id, id, row_number() OVER (PARTITION BY tenant_id, agent_id ORDER BY id) AS seq, {CANONICAL} AS canonical FROM audit_log)"""
LINKED = f"""linked(tenant_id, chain_id, id, chain_seq, prev_hash, self_hash) AS (
 SELECT tenant_id, chain_id, id, seq, '{CONFIG.genesis_hex}', {_hash('seq', f"'{CONFIG.genesis_hex}'")} FROM chain_rows WHERE seq = 1
 UNION ALL SELECT r.tenant_id, r.chain_id, r.id, r.seq, l.self_hash, {_hash('r.seq', 'l.self_hash', 'r.canonical', 'r.chain_id')}
 FROM linked l JOIN chain_rows r ON r.tenant_id = l.tenant_id AND r.chain_id = l.chain_id AND r.seq = l.chain_seq + 1)"""


def _recursive(body, *ctes):
    return over_audit(body, *ctes).replace("WITH audit_log", "WITH RECURSIVE audit_log", 1).replace("RECURSIVE chain_rows", "chain_rows", 1)


def _log(spark, d):
    return t.audit_log(spark, d).withColumn("chain_id", F.col("agent_id")).drop("k")


def _chained(spark, d, config):
    log = _log(spark, d)
    links = c.build_chain(log, config).drop("tenant_id", "chain_id")
    return log.join(links, "id")


@query("canonical_rows", over_audit(f"SELECT id, sha256({CANONICAL}) AS digest FROM audit_log"))
def canonical_rows(spark, d):
    log = _log(spark, d)
    return log.select("id", F.sha2(c.canonical_bytes(log), 256).alias("digest"))


@query("envelope_hash", over_audit(f"""
SELECT id, {_hash('(id + 1)', "sha256(event_uuid)", f'({CANONICAL})', 'agent_id')} AS self_hash FROM audit_log"""))
def envelope_hash(spark, d):
    log = _log(spark, d)
    seq, prev = F.col("id") + 1, F.sha2("event_uuid", 256)
    return log.select("id", c.envelope_hash(c.canonical_bytes(log), F.col("chain_id"), seq, prev, CONFIG).alias("self_hash"))


@query("build_chain", _recursive("SELECT id, chain_seq, prev_hash, self_hash FROM linked", ROWS, LINKED))
def build_chain(spark, d):
    return c.build_chain(_log(spark, d), CONFIG).select("id", "chain_seq", "prev_hash", "self_hash")


@query("verify_chain", over_audit("""
SELECT tenant_id, agent_id AS chain_id, 'VALID_AT_OBSERVED_HEAD' AS outcome, NULL::BIGINT AS break_seq, NULL::BIGINT AS break_id, count(*) AS total_rows, 0::BIGINT AS unchained, 0 AS code
FROM audit_log GROUP BY 1, 2"""))
def verify_chain(spark, d):
    chained = _chained(spark, d, CONFIG)
    return c.verify_chain(chained, c.chain_state(chained, CONFIG), CONFIG)


@query("verify_keyed_chain", over_audit("""
SELECT tenant_id, agent_id AS chain_id, 'VALID_AT_OBSERVED_HEAD' AS outcome, count(*) AS total_rows, 0 AS code FROM audit_log GROUP BY 1, 2"""))
def verify_keyed_chain(spark, d):
    chained = _chained(spark, d, HMAC_CONFIG)
    return c.verify_chain(chained, c.chain_state(chained, HMAC_CONFIG), HMAC_CONFIG).select("tenant_id", "chain_id", "outcome", "total_rows", "code")


@query("verify_damaged_chain", over_audit("""
SELECT tenant_id, chain_id, CASE a WHEN 1 THEN 'seq_gap' WHEN 2 THEN 'self_mismatch' WHEN 3 THEN 'prev_mismatch' WHEN 4 THEN 'half_chained' WHEN 5 THEN 'mode_downgrade' WHEN 6 THEN 'bad_format'
  WHEN 7 THEN 'head_mismatch' WHEN 8 THEN 'coverage_incomplete' WHEN 9 THEN 'seq_duplicate' ELSE 'VALID_AT_OBSERVED_HEAD' END AS outcome,
 CASE WHEN a IN (1, 2, 3, 5, 6) THEN 5 WHEN a = 4 THEN 0 WHEN a = 7 THEN n WHEN a = 9 THEN 4 END::BIGINT AS break_seq,
 CASE WHEN a = 1 THEN i6 WHEN a IN (2, 3, 4, 5, 6, 9) THEN i5 WHEN a = 7 THEN last_id END AS break_id
FROM (SELECT tenant_id, agent_id AS chain_id, CAST(substr(agent_id, 7) AS INT) % 10 AS a, count(*) AS n, max(id) AS last_id,
  max(id) FILTER (seq = 5) AS i5, max(id) FILTER (seq = 6) AS i6 FROM (SELECT *, row_number() OVER (PARTITION BY tenant_id, agent_id ORDER BY id) AS seq FROM audit_log) GROUP BY ALL)"""))
def verify_damaged_chain(spark, d):
    """One kind of damage per chain, at its fifth row (the last row for heads and coverage)."""
    chained = _chained(spark, d, CONFIG)
    state = c.chain_state(chained, CONFIG)
    kind = F.substr("chain_id", F.lit(7)).cast("int") % 10
    fifth = F.col("chain_seq") == 5
    hit = lambda n: fifth & (kind == n)
    last = (kind == 8) & (F.col("chain_seq") == F.col("head_seq"))
    heads = chained.join(state.select("tenant_id", "chain_id", "head_seq"), c.KEYS)
    damaged = heads.filter(~hit(1)).withColumns(
        {
            "decision": F.when(hit(2), "allowed").otherwise(F.col("decision")),
            "prev_hash": F.when(hit(3), F.sha2(F.lit("x"), 256)).otherwise(F.col("prev_hash")),
            "chain_key_version": F.when(hit(5), 9).otherwise(F.col("chain_key_version")),
            "self_hash": F.when(hit(6), "not a hash").when(~last, F.col("self_hash")),
            "chain_seq": F.when(hit(4) | last, F.lit(None).cast("bigint")).when(hit(9), 4).otherwise(F.col("chain_seq")),
        }
    )
    unlinked = F.col("chain_seq").isNull() & (kind == 8)
    damaged = damaged.withColumns({n: F.when(~unlinked, F.col(n)) for n in ("prev_hash", "self_hash", "chain_key_version", "chain_format_version")})
    shrunk = state.join(
        damaged.filter("chain_seq IS NOT NULL").groupBy(*c.KEYS).agg(F.max(F.struct("chain_seq", "id", "self_hash")).alias("m")), c.KEYS
    ).withColumns(
        {
            "head_seq": F.when(kind == 8, F.col("m.chain_seq")).otherwise(F.col("head_seq")),
            "head_id": F.when(kind == 8, F.col("m.id")).otherwise(F.col("head_id")),
            "head_hash": F.when(kind == 8, F.col("m.self_hash")).when(kind == 7, F.sha2(F.lit("y"), 256)).otherwise(F.col("head_hash")),
        }
    )
    return c.verify_chain(damaged.drop("head_seq"), shrunk, CONFIG).select("tenant_id", "chain_id", "outcome", "break_seq", "break_id")


@query("sequence_audit", over_audit("""
SELECT tenant_id, agent_id AS chain_id, count(*) AS rows, count(DISTINCT s) AS distinct_seq, min(s) AS min_seq, max(s) AS max_seq, count(*) - count(s) AS null_seq
FROM (SELECT *, CASE WHEN k % 20 = 0 THEN NULL WHEN k % 21 = 0 THEN 1 ELSE id END AS s FROM audit_log) GROUP BY 1, 2"""))
def sequence_audit(spark, d):
    seq = F.when(F.col("k") % 20 == 0, None).when(F.col("k") % 21 == 0, 1).otherwise(F.col("id"))
    return c.sequence_audit(t.audit_log(spark, d).withColumns({"chain_id": F.col("agent_id"), "chain_seq": seq}))


_CHECKPOINTS = """SELECT CASE WHEN o_custkey % 2 = 0 THEN 't0' ELSE 't1' END AS tenant_id, concat('chain-', CAST(o_custkey % 4 AS STRING)) AS chain_id, o_orderkey AS ordinal,
 CAST(sha2(CAST(o_orderkey AS STRING), 256) AS STRING) AS archive_sha256, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 40 ELSE 0 END AS INT), 0) AS created_at,
 TIMESTAMP '2024-01-02 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(o_orderkey - CASE WHEN o_orderkey % 51 = 0 THEN 40 ELSE 0 END AS INT), 0) AS signed_at,
 CAST(floor(o_orderkey / 8) AS BIGINT) * 10 - CASE WHEN o_orderkey % 53 = 0 THEN 1000 ELSE 0 END AS head_seq,
 CAST(sha2(concat('h', CAST(CAST(floor(o_orderkey / 8) AS BIGINT) + CASE WHEN o_orderkey % 59 = 0 THEN 1 ELSE 0 END AS STRING)), 256) AS STRING) AS head_hash FROM orders"""
_CHECKPOINTS_SQL = (
    _CHECKPOINTS.replace("sha2(CAST(o_orderkey AS STRING), 256)", "sha256(CAST(o_orderkey AS STRING))")
    .replace("sha2(concat('h', ", "sha256(concat('h', ").replace(" AS STRING)), 256)", " AS STRING)))")
    .replace("make_interval(0, 0, 0, 0, 0, CAST(o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 40 ELSE 0 END AS INT), 0)", "to_minutes(o_orderkey - CASE WHEN o_orderkey % 50 = 0 THEN 40 ELSE 0 END)")
    .replace("make_interval(0, 0, 0, 0, 0, CAST(o_orderkey - CASE WHEN o_orderkey % 51 = 0 THEN 40 ELSE 0 END AS INT), 0)", "to_minutes(o_orderkey - CASE WHEN o_orderkey % 51 = 0 THEN 40 ELSE 0 END)")
)


def _checkpoints(spark, d):
    base = t.select_over(spark, _CHECKPOINTS, "orders", t.load(spark, d, "orders"))
    return base.withColumns({c_: F.col(c_).cast("timestamp_ntz") for c_ in ("created_at", "signed_at")})


# Every seventeenth link is forged; the next one then points to a digest that no longer is.
_FORGED = "ordinal % 17 = 5"


@query("verify_checkpoints", with_ctes(f"""
SELECT tenant_id, chain_id, ordinal, CASE WHEN created_at <= pc THEN 'created_not_later' WHEN signed_at < ps THEN 'signed_earlier' WHEN head_seq < ph THEN 'head_went_back'
 WHEN head_seq = ph AND head_hash <> phh THEN 'head_hash_changed' WHEN {_FORGED} OR forged THEN 'link_broken' END AS problem
FROM (SELECT *, lag(created_at) OVER w AS pc, lag(signed_at) OVER w AS ps, lag(head_seq) OVER w AS ph, lag(head_hash) OVER w AS phh, coalesce(lag({_FORGED}) OVER w, false) AS forged
  FROM checkpoints WINDOW w AS (PARTITION BY tenant_id, chain_id ORDER BY ordinal)) WHERE problem IS NOT NULL""", f"checkpoints AS ({_CHECKPOINTS_SQL})"))
def verify_checkpoints(spark, d):
    """True links over all checkpoints, some forged afterwards: order, heads and links."""
    return c.verify_checkpoints(_forged(c.link_checkpoints(_checkpoints(spark, d))))


def _forged(linked):
    return linked.withColumn("previous_sha256", F.when(F.expr(_FORGED), F.lit("f" * 64)).otherwise(F.col("previous_sha256")))


@query("checkpoint_heads", with_ctes(f"""
SELECT tenant_id, chain_id, count(*) AS n, NOT ({_FORGED.replace('ordinal', 'max(ordinal)')}) AS trusted FROM checkpoints GROUP BY 1, 2""", f"checkpoints AS ({_CHECKPOINTS_SQL})"))
def checkpoint_heads(spark, d):
    """Whether each chain still ends in the digest that was trusted when it was intact."""
    linked = c.link_checkpoints(_checkpoints(spark, d))
    return c.verify_heads(_forged(linked), c.checkpoint_heads(linked))


_OBSERVED = """SELECT c_nationkey AS instance_id, c_custkey % 9 AS key_id, min(concat('c', CAST(c_custkey % 2 AS STRING))) AS commitment, c_custkey % 9 = c_nationkey % 9 AS active, 5 AS revision
 FROM customer WHERE c_custkey % 9 < 6 GROUP BY 1, 2, 4"""
_REGISTRY = """SELECT c_nationkey AS instance_id, c_custkey % 9 AS key_id, min(concat('c', CAST((c_custkey + CASE WHEN c_nationkey % 4 = 0 AND c_custkey % 9 = 1 THEN 1 ELSE 0 END) % 2 AS STRING))) AS commitment,
 CASE WHEN c_custkey % 9 = c_nationkey % 9 THEN 'active' WHEN c_custkey % 9 = 8 THEN 'legacy' WHEN c_nationkey = 7 AND c_custkey % 9 = 2 THEN 'retired' ELSE 'standby' END AS state,
 CASE WHEN c_nationkey % 3 = 0 THEN 4 ELSE 5 END AS config_revision FROM customer WHERE c_custkey % 9 <> 4 GROUP BY 1, 2, 4, 5"""


@query("key_drift", with_ctes("""
SELECT instance_id, key_id, number, kind FROM (SELECT *, bool_or(number = 2) OVER (PARTITION BY instance_id) AS fatal FROM (
 SELECT coalesce(o.instance_id, r.instance_id) AS instance_id, coalesce(o.key_id, r.key_id) AS key_id, unnest(list_filter([
  CASE WHEN o.active AND o.commitment <> r.commitment THEN {'number': 2, 'kind': 'active_commitment_mismatch'} END,
  CASE WHEN o.key_id IS NOT NULL AND r.state = 'retired' THEN {'number': 2, 'kind': 'retired_key_reuse'} END,
  CASE WHEN o.active AND coalesce(r.state, '') <> 'active' THEN {'number': 3, 'kind': 'active_not_registered'} END,
  CASE WHEN NOT o.active AND o.commitment <> r.commitment THEN {'number': 4, 'kind': 'configured_commitment_mismatch'} END,
  CASE WHEN NOT o.active AND r.key_id IS NULL THEN {'number': 5, 'kind': 'standby_unregistered'} END,
  CASE WHEN o.key_id IS NULL THEN {'number': 6, 'kind': 'extra_registered'} END,
  CASE WHEN o.active AND r.state = 'active' AND o.commitment = r.commitment AND o.revision <> r.config_revision THEN {'number': 7, 'kind': 'revision_mismatch'} END], lambda x: x IS NOT NULL), recursive := true)
 FROM observed o FULL JOIN registry r ON r.instance_id = o.instance_id AND r.key_id = o.key_id)) WHERE NOT fatal OR number = 2""", f"observed AS ({_OBSERVED})", f"registry AS ({_REGISTRY})"))
def key_drift(spark, d):
    customer = t.load(spark, d, "customer")
    return c.key_drift(t.select_over(spark, _OBSERVED, "customer", customer), t.select_over(spark, _REGISTRY, "customer", customer))
