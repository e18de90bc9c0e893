"""Personal data: exact base spans, and further spans that boosted trees find among overlapping candidates; native only.

All matching, features and scoring are DataFrame functions on the row; training reads one aggregate.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from palisade.llm.language import held_out

KINDS = ("email", "ip", "card", "phone")
# Private-use characters stand for separators that have been told apart; those of the text are blanked first.
_JOIN, _DOT = "\ue000", "\ue001"
_LOCAL = r"A-Za-z0-9._%+\x{E001}-"
# The given patterns, written so that a scan is linear: a match begins at the end of the last one or where a run
# of its first class begins, and inner separators are single characters of their own.
_EMAIL = rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[A-Za-z0-9-]++\x{{E001}}[A-Za-z0-9\x{{E001}}-]++"
_IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = r"[0-9][0-9\x{E000}]++"
_PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Candidates: anything around an at sign, and any digits with the usual separators between them.
_AT = r"(?:\G|(?<![^\x20\x09-\x0D@<>\[\]\"']))[^\x20\x09-\x0D@<>\[\]\"']++@[^\x20\x09-\x0D@<>\[\]\"']++"
_NUMBER = r"(?:\G|(?<![0-9]))[+(]?[0-9][\x20().0-9-]{5,}[0-9]"
_CUE = r"(?i)mail|phone|tel|call|fax|card|visa|contact|address"
CONTEXT = 24
ROUNDS = 20
RATE = 0.5
PRECISION = 0.95


def _found(text: Column, pattern: str) -> Column:
    """All matches with their bounds in code points, end exclusive."""
    gaps, matches = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    paired = F.arrays_zip(F.slice(gaps, 1, F.size(matches)).alias("gap"), matches.alias("match"))
    item = "struct<start:int,end:int,match:string>"
    empty = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{item}>").alias("spans"))

    def step(acc, x):
        start = acc.at + F.length(x.gap)
        end = start + F.length(x.match)
        return F.struct(end.alias("at"), F.concat(acc.spans, F.array(F.struct(start.alias("start"), end.alias("end"), x.match.alias("match")))).alias("spans"))

    return F.aggregate(paired, empty, step, lambda acc: acc.spans)


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(match, r"\."), lambda p: F.when(F.length(part(p)) <= 3, part(p).cast("int") <= 255).otherwise(False))
    if kind == "card":
        return F.length(_digits(match)).between(14, 19) & F.call_function("luhn_check", _digits(match))
    if kind == "phone":
        return F.length(_digits(match)).between(10, 15)
    return F.lit(True)


def _tagged(spans: Column, kind: str) -> Column:
    return F.transform(
        F.filter(spans, lambda s: _valid(kind, s.match)),
        lambda s: F.struct(s.start.alias("start"), F.lit(KINDS.index(kind)).alias("kind"), s.end.alias("end")),
    )


_SPANS = "array<struct<start:int,kind:int,end:int>>"


def with_base_spans(docs: DataFrame) -> DataFrame:
    """All columns of `docs`, `__t` (the text, blanked where it uses the private characters) and `__base` (spans in order)."""
    text = F.translate(F.coalesce(F.col("text"), F.lit("")), _JOIN + _DOT, "\x01\x01")
    # Only texts with a private character need the copy.
    plain = F.when(F.col("text").rlike(r"[\x{E000}\x{E001}]"), text).otherwise(F.coalesce(F.col("text"), F.lit("")))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    t = F.col("__t")
    dotted = F.regexp_replace(t, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", _DOT)
    joined = F.regexp_replace(t, r"(?<=[0-9])[\x20-](?=[0-9])", _JOIN)
    df = docs.withColumn("__t", plain)
    df = df.withColumns({"__dotted": F.when(t.contains("@"), dotted), "__joined": F.when(t.rlike(r"[0-9]"), joined)})
    df = df.withColumns(
        {
            "__email": F.when(t.contains("@"), _found(F.col("__dotted"), _EMAIL)).otherwise(none),
            "__ip": F.when(t.rlike(r"[0-9]\.[0-9]"), _found(t, _IP)).otherwise(none),
            "__card": F.when(F.col("__joined").isNotNull(), _found(F.col("__joined"), _CARD)).otherwise(none),
            "__phone": F.when(t.contains("+"), _found(t, _PHONE)).otherwise(none),
        }
    )
    base = F.array_sort(F.concat(*[_tagged(F.col(f"__{k}"), k) for k in KINDS]))
    return df.withColumn("__base", base.cast(_SPANS)).drop("__dotted", "__joined", "__email", "__ip", "__card", "__phone")


FEATURES = ("at_sign", "digits", "plus", "paren", "dots", "parts", "domain", "cue", "edges")


def _features(t: Column, s: Column) -> list[Column]:
    """Small whole numbers: format of the candidate and of what stands around it."""
    count = lambda p: F.regexp_count(s.match, F.lit(p))
    before = F.substring(t, F.greatest(s.start - CONTEXT + 1, F.lit(1)), F.least(s.start, F.lit(CONTEXT)))
    left, right = F.substring(t, s.start, F.when(s.start > 0, 1).otherwise(0)), F.substring(t, s.end + 1, F.lit(1))
    return [
        s.match.contains("@").cast("int"),
        F.least(F.length(_digits(s.match)), F.lit(20)),
        s.match.contains("+").cast("int"),
        s.match.contains("(").cast("int"),
        F.least(count(r"\."), F.lit(4)),
        F.least(count(r"[\x20-]"), F.lit(5)),
        s.match.rlike(r"@[A-Za-z0-9.-]*\.[A-Za-z]{2,}").cast("int"),
        before.rlike(_CUE).cast("int"),
        left.rlike(r"[A-Za-z0-9]").cast("int") + 2 * right.rlike(r"[A-Za-z0-9]").cast("int"),
    ]


def with_candidates(df: DataFrame) -> DataFrame:
    """Adds `__candidates`: bounds, kind, whether a base span overlaps, and features `f`, of overlapping proposals."""
    t, none = F.col("__t"), F.array().cast("array<struct<start:int,end:int,match:string>>")
    df = df.withColumn(
        "__proposed",
        F.concat(
            F.when(t.contains("@"), _found(t, _AT)).otherwise(none),
            F.when(t.rlike(r"[0-9][\x20().0-9-]{5,}[0-9]"), _found(t, _NUMBER)).otherwise(none),
        ),
    )

    def described(s):
        n = F.length(_digits(s.match))
        kind = F.when(s.match.contains("@"), 0).when(F.regexp_count(s.match, F.lit(r"\.")) >= 3, 1).when(n > 12, 2).otherwise(3)
        known = F.exists("__base", lambda b: (b.start < s.end) & (s.start < b.end))
        return F.struct(
            s.start.alias("start"), kind.alias("kind"), s.end.alias("end"), known.alias("known"),
            F.struct(*[x.alias(n) for x, n in zip(_features(t, s), FEATURES)]).alias("f"),
        )

    return df.withColumn("__candidates", F.transform("__proposed", described)).drop("__proposed")


@dataclass(frozen=True)
class Node:
    """A split (value <= at goes left), or a leaf with a step of the log-odds."""

    step: float = 0.0
    feature: str = ""
    at: int = 0
    left: Node | None = None
    right: Node | None = None

    def value(self, cell: dict) -> float:
        if self.left is None:
            return self.step
        return (self.left if cell[self.feature] <= self.at else self.right).value(cell)

    def column(self, f: Column) -> Column:
        if self.left is None:
            return F.lit(self.step)
        return F.when(f[self.feature] <= self.at, self.left.column(f)).otherwise(self.right.column(f))


@dataclass(frozen=True)
class Trees:
    prior: float
    trees: tuple[Node, ...]
    threshold: float  # of the summed log-odds; infinite if none is precise enough

    def value(self, cell: dict) -> float:
        return self.prior + sum(t.value(cell) for t in self.trees)

    def column(self, f: Column) -> Column:
        return reduce(lambda a, b: a + b, [t.column(f) for t in self.trees], F.lit(self.prior))


def _grow(cells: list[tuple[dict, float, float]], depth: int) -> Node:
    """A Newton tree over (features, gradient, curvature), sums of all candidates alike."""
    g, h = sum(c[1] for c in cells), sum(c[2] for c in cells)
    leaf, best = Node(RATE * g / (h + 1.0)), (1e-6, None)
    if depth:
        for name in FEATURES:
            by: dict[int, list[float]] = {}
            for features, a, b in cells:
                sums = by.setdefault(features[name], [0.0, 0.0])
                sums[0] += a
                sums[1] += b
            lg = lh = 0.0
            for v in sorted(by)[:-1]:
                lg, lh = lg + by[v][0], lh + by[v][1]
                gain = lg * lg / (lh + 1) + (g - lg) ** 2 / (h - lh + 1) - g * g / (h + 1)
                if gain > best[0]:
                    best = (gain, (name, v))
    if best[1] is None:
        return leaf
    name, v = best[1]
    sides = [[c for c in cells if (c[0][name] <= v) == low] for low in (True, False)]
    return Node(0.0, name, v, *(_grow(side, depth - 1) for side in sides))


def fit(cells: list[dict], rounds: int = ROUNDS, depth: int = 3, precision: float = PRECISION) -> Trees:
    """Boost on cells (features, n, y, cal_n, cal_y): candidates with equal features and how many a base span confirms.

    The threshold is the lowest score at which at least `precision` of the calibration rows above it are confirmed.
    """
    n, y = sum(c["n"] for c in cells), sum(c["y"] for c in cells)
    prior = math.log((y + 1) / (n - y + 1))
    scores, trees = [prior] * len(cells), []
    for _ in range(rounds if y and y < n else 0):
        p = [1 / (1 + math.exp(-s)) for s in scores]
        tree = _grow([(c, c["y"] - c["n"] * q, c["n"] * q * (1 - q)) for c, q in zip(cells, p) if c["n"]], depth)
        trees.append(tree)
        scores = [s + tree.value(c) for s, c in zip(scores, cells)]
    threshold, above, confirmed = math.inf, 0, 0
    ranked = sorted(zip(scores, cells), key=lambda x: -x[0])
    for i, (s, c) in enumerate(ranked):
        above, confirmed = above + c["cal_n"], confirmed + c["cal_y"]
        tied = i + 1 < len(ranked) and ranked[i + 1][0] == s
        if not tied and above and confirmed >= precision * above:
            threshold = s
    return Trees(prior, tuple(trees), threshold)


def train(candidates: DataFrame) -> Trees:
    """Learn from all rows of `candidates` (doc_id, __candidates): four fifths of the documents grow trees, one fifth calibrates.

    Equal features are one cell, so what comes to the driver is bounded by the feature space (nine small whole
    numbers), not by the corpus.
    """
    rows = candidates.select(held_out("doc_id", 5, 0).alias("cal"), F.explode("__candidates").alias("c")).select("cal", "c.f.*", "c.known")
    one, zero = F.lit(1), F.lit(0)
    cells = rows.groupBy(*FEATURES).agg(
        F.sum(F.when(~F.col("cal"), one).otherwise(zero)).alias("n"),
        F.sum(F.when(~F.col("cal") & F.col("known"), one).otherwise(zero)).alias("y"),
        F.sum(F.when(F.col("cal"), one).otherwise(zero)).alias("cal_n"),
        F.sum(F.when(F.col("cal") & F.col("known"), one).otherwise(zero)).alias("cal_y"),
    )
    return fit([r.asDict() for r in cells.orderBy(*FEATURES).collect()])


def _listed(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(names, s.kind), s.start.cast("string"), s.end.cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def find_personal_data(docs: DataFrame, model: Trees | None = None) -> DataFrame:
    """All columns of `docs` and base_spans, added_spans (start, kind as index of KINDS, end; code points) in order.

    Base spans are the matches of the four patterns that pass their checks. Added are candidates that no base span
    overlaps and whose score reaches the model's threshold; without a model it is learned from `docs` (doc_id,
    text). A null text is empty and has no spans. Columns of `docs` with the two names are replaced.
    """
    kept = [c for c in docs.columns if c not in ("base_spans", "added_spans")]
    proposed = with_candidates(with_base_spans(docs.select(*kept)))
    model = model or train(proposed)
    if not model.trees or math.isinf(model.threshold):
        added = F.array().cast(_SPANS)
    else:
        chosen = F.filter("__candidates", lambda c: ~c.known & (model.column(c.f) >= F.lit(model.threshold)))
        added = F.array_sort(F.transform(chosen, lambda c: F.struct(c.start.alias("start"), c.kind.alias("kind"), c.end.alias("end")))).cast(_SPANS)
    return proposed.select(*kept, F.col("__base").alias("base_spans"), added.alias("added_spans"))


def op7_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document: base counts and spans, all spans, and their number."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long"), "text")
    found = find_personal_data(docs).drop("text")
    count = lambda k: F.size(F.filter("base_spans", lambda s: s.kind == KINDS.index(k))).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", *[count(k) for k in KINDS],
        F.sha2(_listed(F.col("base_spans")).cast("binary"), 256).alias("base_sha256"),
        _listed(F.array_sort(F.concat("base_spans", "added_spans"))).alias("spans"),
        (F.size("base_spans") + F.size("added_spans")).cast("long").alias("n_spans"),
    )
