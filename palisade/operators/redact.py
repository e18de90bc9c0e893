"""Mask rules: matching them to columns, applying them to tables, and deciding output masks.

A rule's scope becomes one text key, and each column lists the keys that could cover it in
order of precedence, so matching is a single equi-join plus a `min` per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from palisade.functions.masks import SENSITIVE_TYPES, HashKey, Mask, mask_for
from palisade.functions.text import REDACTED, is_empty_value, utrim
from palisade.session import materialize


@dataclass(frozen=True)
class MaskRule:
    column: str
    sensitive_type: str
    algorithm: str
    width: int | None = None
    offset: int = 0
    granularity: str | None = None


def normalize_name(c: Column | str) -> Column:
    """Trim, drop one pair of identifier quotes, lower-case."""
    trimmed = utrim(c)
    quoted = trimmed.rlike(r'(?s)^(".*"|`.*`|\[.*\])$') & (F.length(trimmed) >= 2)
    inner = F.substr(trimmed, F.lit(2), F.length(trimmed) - 2)
    return F.lower(F.when(quoted, utrim(inner)).otherwise(trimmed))


def type_order(c: Column) -> Column:
    """Position in the fixed type order; unknown types sort last."""
    position = F.array_position(F.array(*[F.lit(t) for t in SENSITIVE_TYPES]), c)
    return F.when(position > 0, position - 1).otherwise(len(SENSITIVE_TYPES)).cast("int")


def _global_key(column: Column) -> Column:
    return F.concat_ws("\u0001", F.lit("g"), column)


def _exact_key(schema: Column, table: Column, column: Column) -> Column:
    return F.concat_ws("\u0001", F.lit("e"), schema, table, column)


def _table_key(table: Column, column: Column) -> Column:
    return F.concat_ws("\u0001", F.lit("t"), table, column)


def _blank(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) == ""


def keyed_rules(rules: DataFrame) -> DataFrame:
    """Rules with their scope key; an empty table means global, an empty schema any schema."""
    column = normalize_name("column_name")
    key = F.when(_blank("table_name"), _global_key(column)).when(
        _blank("schema_name"), _table_key(F.col("table_name"), column)
    ).otherwise(_exact_key(F.col("schema_name"), F.col("table_name"), column))
    return rules.select(
        key.alias("rule_key"),
        "rule_id",
        "sensitive_type",
        "algorithm",
        type_order(F.col("sensitive_type")).alias("type_order"),
        F.when(_blank("table_name"), F.lit(None)).otherwise(
            F.when(_blank("schema_name"), F.concat_ws("\u0001", F.lit("t"), "table_name")).otherwise(
                F.concat_ws("\u0001", F.lit("e"), "schema_name", "table_name")
            )
        ).alias("relation_key"),
    )


def _candidate(tier: int, key: Column, condition: Column) -> Column:
    return F.when(condition, F.struct(F.lit(tier).alias("tier"), key.alias("rule_key")))


FALLBACK_TIER = 10


def resolve_mask_rules(columns: DataFrame, rules: DataFrame, ids: Sequence[str]) -> DataFrame:
    """The rule that covers each result column, or the block fallback where a scoped rule might.

    `columns`: ids, result_name, source_schema, source_table, source_column and
    possible_relations (array of schema_name/table_name). Columns no rule covers are absent.
    """
    result, source = normalize_name("result_name"), normalize_name("source_column")
    has_source, has_table, has_schema = ~_blank("source_column"), ~_blank("source_table"), ~_blank("source_schema")
    renamed = has_source & (F.col("result_name") != F.col("source_column"))
    direct = F.array(
        _candidate(1, _global_key(result), renamed),
        _candidate(2, _exact_key(F.col("source_schema"), F.col("source_table"), source), has_table & has_schema),
        _candidate(3, _table_key(F.col("source_table"), source), has_table),
        _candidate(4, _global_key(result), F.lit(True)),
        _candidate(5, _global_key(source), has_source),
    )
    names = F.array_distinct(F.array_compact(F.array(result, F.when(has_source, source))))
    possible = F.when(~has_table, F.coalesce("possible_relations", F.array().cast(columns.schema["possible_relations"].dataType)))
    fallback = F.flatten(
        F.transform(
            possible,
            lambda relation: F.flatten(
                F.transform(
                    names,
                    lambda name: F.array(
                        F.struct(
                            F.lit(FALLBACK_TIER).alias("tier"),
                            _exact_key(relation["schema_name"], relation["table_name"], name).alias("rule_key"),
                        ),
                        F.struct(F.lit(FALLBACK_TIER).alias("tier"), _table_key(relation["table_name"], name).alias("rule_key")),
                    ),
                )
            ),
        )
    )
    candidates = F.concat(F.array_compact(direct), F.coalesce(fallback, F.array().cast("array<struct<tier:int,rule_key:string>>")))
    keyed = columns.select(*ids, F.inline(candidates))
    rank = F.struct("tier", "type_order", "rule_id")
    best = keyed.join(keyed_rules(rules), "rule_key").groupBy(*ids).agg(
        F.min_by(F.struct("tier", "rule_id", "sensitive_type", "algorithm"), rank).alias("b")
    )
    blocked = F.col("b.tier") == FALLBACK_TIER
    return best.select(
        *ids,
        F.col("b.tier").alias("tier"),
        F.when(~blocked, F.col("b.rule_id")).alias("rule_id"),
        F.col("b.sensitive_type").alias("sensitive_type"),
        F.when(blocked, "block").otherwise(F.col("b.algorithm")).alias("algorithm"),
    )


def _mask(rule: MaskRule, key: HashKey | None) -> Mask:
    return mask_for(
        F.col(rule.column), rule.sensitive_type, rule.algorithm, key, rule.width, rule.offset, rule.granularity
    )


def redact(df: DataFrame, rules: Sequence[MaskRule], key: HashKey | None = None) -> DataFrame:
    """All rules in one projection; works unchanged on a stream. Columns without a rule keep their type."""
    by_column = {rule.column: rule for rule in rules}
    return df.select(
        *[_mask(by_column[c], key).value.alias(c) if c in by_column else F.col(c) for c in df.columns]
    )


def _touched(rules: Sequence[MaskRule], key: HashKey | None) -> list[Column]:
    return [F.count_if(_mask(rule, key).applied).alias(f"__m{i}") for i, rule in enumerate(rules)]


def _report_rows(rules: Sequence[MaskRule], key: HashKey | None) -> Column:
    rows = []
    for i, rule in enumerate(rules):
        fell_back = rule.algorithm == "hash" and key is None
        used = rule.algorithm == "hash" and key is not None
        rows.append(
            F.struct(
                F.lit(rule.column).alias("column_name"),
                F.lit(rule.sensitive_type).alias("sensitive_type"),
                F.col(f"__m{i}").alias("masked_cells"),
                (F.col(f"__m{i}") if fell_back else F.lit(0).cast("bigint")).alias("hash_fallbacks"),
                F.when((F.col(f"__m{i}") > 0) & F.lit(used), F.lit(key.version if key else None)).cast("int").alias("key_version"),
            )
        )
    return F.inline(F.array(*rows))


def redaction_report(df: DataFrame, rules: Sequence[MaskRule], key: HashKey | None = None) -> DataFrame:
    """Per touched column: masked cells, hash fallbacks and the key version used, in one aggregate."""
    return df.agg(*_touched(rules, key)).select(_report_rows(rules, key))


def redact_observed(df: DataFrame, rules: Sequence[MaskRule], key: HashKey | None = None) -> tuple[DataFrame, Callable[[], DataFrame]]:
    """The redacted frame, and its report: counted in the same pass, so it is there once the frame has been written or read.

    Asking for the report waits for the first action on the frame, and counts the rows that action went through.
    """
    seen = Observation()
    observed = redact(df.observe(seen, *_touched(rules, key)), rules, key)

    def report() -> DataFrame:
        counts = seen.get
        values = [F.lit(int(counts[f"__m{i}"])).cast("bigint").alias(f"__m{i}") for i in range(len(rules))]
        return df.sparkSession.range(1).select(*values).select(_report_rows(rules, key))

    return observed, report


def fingerprint_versions(df: DataFrame, column: str) -> DataFrame:
    """Census of key versions among the cells of a column; 0 counts the cells that are no fingerprint."""
    from palisade.functions.masks import fingerprint_version

    filled = ~is_empty_value(utrim(column))
    return df.filter(filled).groupBy(F.coalesce(fingerprint_version(column), F.lit(0)).alias("version")).agg(
        F.count(F.lit(1)).alias("n")
    )


def verify_fingerprints(df: DataFrame, column: str, plain: str, key: HashKey) -> DataFrame:
    """How many cells are, and are not, the fingerprint of their plain value under the key."""
    from palisade.functions.masks import fingerprint_text

    ok = F.coalesce(F.col(column) == fingerprint_text(plain, key), F.lit(False))
    return df.agg(F.count_if(ok).alias("verified"), F.count_if(~ok).alias("mismatched"))


# Expression kinds and operations that leave a value recognisable.
_TRANSPARENT = ("parentheses", "collate", "coalesce_null", "concat_empty")
_SOURCE_FREE_COUNT = ("aggregate:count", "aggregate:count_star", "aggregate:count_constant")


def decide_output_masks(lineage: DataFrame, rules: DataFrame) -> DataFrame:
    """Mask decision per query output: `rule` keeps one exact rule, `block` hides, absent means clear.

    `lineage` holds one row per dependency: query_id, output_index, result_name, arm_index,
    kind, operation, status, dep_schema, dep_table, dep_column, dep_role (NULL dependency columns
    for an arm without any; NULL arm_index for an output without arms) and possible_relations.
    """
    keyed = keyed_rules(rules)
    rule = F.struct("rule_id", "algorithm", "type_order")
    origin_keys = ["dep_schema", "dep_table", "dep_column"]
    out_keys = ["query_id", "output_index"]
    arm_keys = [*out_keys, "arm_index"]

    # Rules are settled on the distinct origins, result names and relation lists of the log, and written: their sizes
    # are then known before the log is joined to them, so it is not dealt by these few-valued keys, and folded twice.
    column = normalize_name("dep_column")
    candidates = F.array_compact(
        F.array(
            _candidate(1, _exact_key(F.col("dep_schema"), F.col("dep_table"), column), ~_blank("dep_schema") & ~_blank("dep_table")),
            _candidate(2, _table_key(F.col("dep_table"), column), ~_blank("dep_table")),
            _candidate(3, _global_key(column), F.lit(True)),
        )
    )
    dep_rules = (
        lineage.filter(F.col("dep_column").isNotNull())
        .select(*origin_keys)
        .distinct()
        .select(*origin_keys, F.inline(candidates))
        .join(keyed, "rule_key")
        .groupBy(*origin_keys)
        .agg(F.min_by(rule, F.struct("tier", "rule_id")).alias("dep_rule"))
    )
    result_rules = (
        lineage.select("result_name")
        .distinct()
        .withColumn("rule_key", _global_key(normalize_name("result_name")))
        .join(keyed, "rule_key")
        .groupBy("result_name")
        .agg(F.min(rule).alias("result_rule"))
    )
    relation_keys = F.flatten(
        F.transform(
            "possible_relations",
            lambda r: F.array(
                F.concat_ws("\u0001", F.lit("e"), r["schema_name"], r["table_name"]),
                F.concat_ws("\u0001", F.lit("t"), r["table_name"]),
            ),
        )
    )
    scoped = keyed.filter(F.col("relation_key").isNotNull()).groupBy("relation_key").agg(F.min("type_order").alias("possible_order"))
    possible = (
        lineage.select("possible_relations")
        .distinct()
        .select("possible_relations", F.explode(F.array_distinct(relation_keys)).alias("relation_key"))
        .join(scoped, "relation_key")
        .groupBy("possible_relations")
        .agg(F.min("possible_order").alias("possible_order"))
    )
    all_order = keyed.agg(F.min("type_order")).scalar()

    dep_rules, result_rules, possible = (
        materialize(df, label) for df, label in ((dep_rules, "mask-origins"), (result_rules, "mask-results"), (possible, "mask-relations"))
    )
    same_origin = [F.col(f"l.{c}").eqNullSafe(F.col(f"d.{c}")) for c in origin_keys]
    joined = (
        lineage.alias("l")
        .join(dep_rules.alias("d"), same_origin, "left")
        .select("l.*", "d.dep_rule")
        .join(result_rules, "result_name", "left")
        .join(possible, "possible_relations", "left")
        .withColumn("__op", F.lower(F.trim(F.coalesce("operation", F.lit("")))))
    )
    has_dep = F.col("dep_column").isNotNull()
    origin = F.struct(F.coalesce("dep_schema", F.lit("")), F.coalesce("dep_table", F.lit("")), column)
    arms = joined.groupBy(*arm_keys).agg(
        F.min("kind").alias("kind"),
        F.min("__op").alias("op"),
        F.min("status").alias("status"),
        F.count_if(has_dep).alias("deps"),
        F.max(F.when(has_dep, F.col("dep_role"))).alias("role"),
        F.max(F.when(has_dep, origin)).alias("origin"),
        F.max("dep_rule").alias("dep_rule"),
        F.min("dep_rule.type_order").alias("dep_order"),
        F.max("result_rule").alias("result_rule"),
        F.min("possible_order").alias("possible_order"),
        F.max(F.size("possible_relations")).alias("relations"),
    )
    has_arm = F.col("arm_index").isNotNull()
    resolved, free = F.col("status") == "resolved", F.col("status") == "source_free"
    valid_free = free & (F.col("deps") == 0) & (
        (F.col("kind") == "constant") | ((F.col("kind") == "aggregate") & F.col("op").isin(*_SOURCE_FREE_COUNT))
    )
    global_order = F.col("result_rule.type_order")
    has_global = F.col("result_rule").isNotNull()
    uses_possible = F.when(resolved, F.col("kind").isin("opaque", "wildcard") | (F.col("deps") == 0)).otherwise(~free)
    no_information = ~resolved & ~free & (F.col("deps") == 0) & (F.coalesce("relations", F.lit(0)) <= 0)
    relevant = F.least(
        F.when(~(free & (has_global | valid_free)), F.col("dep_order")),
        F.when(uses_possible, F.col("possible_order")),
        F.when(no_information, all_order),
        global_order,
    )
    simple = resolved & (
        (F.col("kind") == "direct") | ((F.col("kind") == "transparent") & F.col("op").isin(*_TRANSPARENT))
    ) & (F.col("deps") == 1) & (F.col("role") == "value")
    conflict = F.col("dep_rule").isNotNull() & has_global & (F.col("dep_rule.rule_id") != F.col("result_rule.rule_id"))
    chosen = F.when(simple, F.coalesce("dep_rule", "result_rule")).when(valid_free, F.col("result_rule"))
    range_concat = (F.col("kind") == "transparent") & (F.col("op") == "concat_empty") & (chosen["algorithm"] == "range")
    exact = has_arm & chosen.isNotNull() & ~F.coalesce(simple & (conflict | range_concat), F.lit(False))
    decided = arms.select(
        *out_keys,
        has_arm.alias("has_arm"),
        relevant.alias("relevant"),
        F.coalesce(exact, F.lit(False)).alias("exact"),
        F.when(F.coalesce(exact, F.lit(False)), chosen["rule_id"]).alias("rule_id"),
        F.when(simple, F.col("origin")).alias("origin"),
        F.when(F.coalesce(exact, F.lit(False)), chosen["type_order"]).alias("rule_order"),
        (~has_arm | ~F.coalesce(resolved | free, F.lit(False))).alias("uncertain"),
    )
    # Arms agree when all are exact and name one rule and one origin.
    blank_origin = F.to_json(F.col("origin"))
    outputs = decided.groupBy(*out_keys).agg(
        F.bool_and("exact").alias("all_exact"),
        F.min("rule_id").alias("rule_low"),
        F.max("rule_id").alias("rule_high"),
        F.min(F.coalesce(blank_origin, F.lit(""))).alias("origin_low"),
        F.max(F.coalesce(blank_origin, F.lit(""))).alias("origin_high"),
        F.min("relevant").alias("relevant"),
        F.min("rule_order").alias("rule_order"),
        F.bool_or("uncertain").alias("uncertain"),
    )
    agreed = F.col("all_exact") & (F.col("rule_low") == F.col("rule_high")) & (F.col("origin_low") == F.col("origin_high"))
    types = F.array(*[F.lit(t) for t in SENSITIVE_TYPES])
    order = F.when(agreed, F.col("rule_order")).otherwise(F.col("relevant"))
    return outputs.filter(F.col("relevant").isNotNull()).select(
        *out_keys,
        F.when(agreed, "rule").otherwise("block").alias("decision"),
        F.when(agreed, F.col("rule_low")).alias("rule_id"),
        F.coalesce(F.get(types, order), F.lit("generic")).alias("sensitive_type"),
        (~agreed & F.col("uncertain")).alias("unresolved"),
    )


def meet_masks(candidates: DataFrame) -> DataFrame:
    """Agreement of the masks meant for one output position.

    `candidates`: query_id, output_index, ordinal, identity (text, NULL for none), input_type,
    type_digest, capable. The first failing candidate in order supplies the reason.
    """
    keys = ["query_id", "output_index"]
    named = candidates.filter(F.col("identity").isNotNull())
    first = named.groupBy(*keys).agg(F.min_by("identity", "ordinal").alias("chosen"))
    reason = (
        F.when(~F.col("capable"), "MASK_CAPABILITY_MISSING")
        .when(F.col("input_type") != F.col("type_digest"), "MASK_MEET_UNDEFINED")
        .when(F.col("identity") != F.col("chosen"), "MASK_MEET_UNDEFINED")
    )
    checked = named.join(first, keys).withColumn("reason", reason)
    failing = F.when(F.col("reason").isNotNull(), F.col("ordinal"))
    return checked.groupBy(*keys).agg(F.min_by("reason", failing).alias("reason"), F.min("chosen").alias("identity")).select(
        *keys, F.coalesce("reason", F.lit("ALLOW")).alias("reason"), F.when(F.col("reason").isNull(), F.col("identity")).alias("identity")
    )


__all__ = [
    "REDACTED", "MaskRule", "decide_output_masks", "fingerprint_versions", "keyed_rules", "meet_masks",
    "normalize_name", "redact", "redaction_report", "resolve_mask_rules", "type_order", "verify_fingerprints",
]
