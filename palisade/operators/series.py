"""Chart series, shares and linear forecasts over result tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from palisade.functions.profile import per_column
from palisade.functions.segments import join_same, previous

# Fixed value: plain decimal text, as JSON writes numbers.
_JSON_NUMBER = r"^-?(0|[1-9][0-9]*)(\.[0-9]+)?([eE][+-]?[0-9]+)?$"
_EXACT = 9007199254740991.0
SHOWN_ROWS = 20


def chart_number(c: Column) -> Column:
    """The cell as a plottable number, NULL when it is not one within the exact integer range."""
    text = F.trim(c.cast("string"))
    number = text.try_cast("double")
    vanished = (number == 0) & F.regexp_replace(text, "[eE].*$", "").rlike("[1-9]")
    return F.when(text.rlike(_JSON_NUMBER) & ~F.isnan(number) & (F.abs(number) < _EXACT) & ~vanished, number)


def numeric_fields(df: DataFrame) -> DataFrame:
    """Per column: does every non-null cell hold a number, with at least one present? One aggregate."""
    def aggregates(i: int, name: str) -> list[Column]:
        cell = F.col(f"`{name}`")
        good = cell.isNull() | chart_number(cell).isNotNull()
        return [F.bool_and(good).alias(f"__a{i}"), F.count(cell).alias(f"__n{i}")]

    def row(i: int, name: str) -> Column:
        numeric = F.coalesce(F.col(f"__a{i}"), F.lit(False)) & (F.col(f"__n{i}") > 0)
        return F.struct(F.lit(name).alias("field"), numeric.alias("numeric"), F.col(f"__n{i}").alias("present"))

    return per_column(df, df.columns, aggregates, row)


def chart_series(df: DataFrame, dimension: str, measures: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """Long form of the first 20 rows: label, measure and value, a missing value staying NULL."""
    if not 1 <= len(measures) <= 4:
        raise ValueError("a chart shows one to four measures")
    first = df.orderBy(*order).limit(SHOWN_ROWS)
    values = F.array(*[F.struct(F.lit(m).alias("measure"), chart_number(F.col(m)).alias("value")) for m in measures])
    return first.select(F.coalesce(F.col(dimension).cast("string"), F.lit("")).alias("label"), F.inline(values))


def shares(df: DataFrame, label: str, value: str, order: Sequence[Column | str]) -> DataFrame:
    """Share of each of the first 20 rows in their sum; missing and zero rows have no share.

    The window spans at most 20 rows: the limit comes first.
    """
    first = df.orderBy(*order).limit(SHOWN_ROWS).select(F.col(label).cast("string").alias("label"), chart_number(F.col(value)).alias("value"))
    total = F.sum("value").over(Window.partitionBy(F.lit(1)))
    return first.withColumn("share", F.try_divide("value", total)).filter(F.col("value") > 0)


# Fixed value: forecasts beyond it are not given.
LARGEST = 1e15
LABEL_KINDS = ("date", "month", "year", "number")


def _positions(label: Column) -> dict[str, Column]:
    """The label read as each kind; NULL where it is not that kind."""
    day = F.when(label.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.unix_date(F.try_to_date(label, "yyyy-MM-dd")))
    month_number = F.substring(label, 6, 2).try_cast("int")
    month = F.when(
        label.rlike(r"^[0-9]{4}-[0-9]{2}$") & month_number.between(1, 12), F.substring(label, 1, 4).try_cast("int") * 12 + month_number - 1
    )
    year = F.when(label.rlike(r"^[0-9]{4}$"), label.try_cast("int"))
    number = label.try_cast("double")
    number = F.when(~F.isnan(number) & (F.abs(number) < float("inf")), number)
    return {k: c.cast("double") for k, c in zip(LABEL_KINDS, (day, month, year, number))}


def _plain_digits(x: Column) -> Column:
    """The shortest digits of a number, without an exponent."""
    digits = x.cast("string").try_cast("decimal(38,18)").cast("string")
    return F.coalesce(F.regexp_replace(digits, r"\.?0+$", ""), x.cast("string"))


def _label(kind: Column, x: Column) -> Column:
    whole = F.round(x).cast("bigint")
    month = F.concat(F.lpad(F.floor(whole / 12).cast("string"), 4, "0"), F.lit("-"), F.lpad((whole % 12 + 1).cast("string"), 2, "0"))
    return (
        F.when(kind == "date", F.date_format(F.date_from_unix_date(whole.cast("int")), "yyyy-MM-dd"))
        .when(kind == "month", month)
        .when(kind == "year", whole.cast("string"))
        .otherwise(_plain_digits(x))
    )


def forecast(
    df: DataFrame,
    group_cols: Sequence[str],
    label: str,
    value: str,
    order: str,
    horizon: int = 3,
    slice_col: Column | None = None,
) -> DataFrame:
    """Least-squares continuation of many series: `horizon` points after the last label.

    A series needs three or more rows, finite values, and labels of one kind that rise strictly
    along `order`. The step is the upper median of the label gaps. Only sums and a count of gaps per
    length are kept per series, never its rows. `slice_col` cuts long series (it must follow `order`).
    """
    keys = list(group_cols)
    text = F.col(label).cast("string")
    cut = F.lit(0) if slice_col is None else slice_col
    sliced = df.select(
        *keys,
        F.col(order).alias("__at"),
        F.col(value).cast("double").alias("__y"),
        *[c.alias(f"__{k}") for k, c in _positions(text).items()],
        cut.alias("__cut"),
    )
    marks = [f"__{k}" for k in LABEL_KINDS]
    stepped = previous(sliced.withColumn("__seen", F.lit(True)), keys, ["__at"], F.col("__cut"), [*marks, "__seen"], "__p")
    first = F.col("__p__seen").isNull()
    rises = lambda k: F.col(f"__{k}").isNotNull() & (first | F.coalesce(F.col(f"__{k}") > F.col(f"__p__{k}"), F.lit(False)))
    # Every kind is fitted in the one pass over the rows; the series' own kind is picked afterwards.
    fit = lambda k: F.struct(
        F.lit(k).alias("kind"),
        F.regr_slope("__y", f"__{k}").alias("slope"),
        F.avg(f"__{k}").alias("x_mean"),
        F.max(f"__{k}").alias("x_last"),
    )
    fits = stepped.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("input_rows"),
        F.avg("__y").alias("y_mean"),
        F.bool_and(F.coalesce(~F.isnan("__y") & (F.abs("__y") < float("inf")), F.lit(False))).alias("finite"),
        *[F.bool_and(rises(k)).alias(f"is_{k}") for k in LABEL_KINDS],
        *[fit(k).alias(f"fit_{k}") for k in LABEL_KINDS],
    )
    usable = fits.filter((F.col("input_rows") >= 3) & F.col("finite")).select(
        *keys, "input_rows", "y_mean", F.coalesce(*[F.when(F.col(f"is_{k}"), F.col(f"fit_{k}")) for k in LABEL_KINDS]).alias("f")
    )
    usable = usable.filter(F.col("f").isNotNull()).select(*keys, "input_rows", "y_mean", "f.*")
    # Gaps repeat a lot, so their median comes from counted distinct lengths.
    gap = lambda k: F.struct(F.lit(k).alias("kind"), (F.col(f"__{k}") - F.col(f"__p__{k}")).alias("gap"))
    counted = (
        stepped.select(*keys, F.inline(F.array(*[gap(k) for k in LABEL_KINDS])))
        .filter(F.col("gap").isNotNull())
        .groupBy(*keys, "kind", "gap")
        .agg(F.count(F.lit(1)).alias("times"))
    )
    gaps = join_same(counted, usable.select(*keys, "kind", "input_rows"), [*keys, "kind"])
    upto = Window.partitionBy(*keys).orderBy("gap").rowsBetween(Window.unboundedPreceding, 0)
    step = (
        gaps.withColumn("__upto", F.sum("times").over(upto))
        .filter(F.col("__upto") > F.floor((F.col("input_rows") - 1) / 2))
        .groupBy(*keys)
        .agg(F.min("gap").alias("step"))
    )
    at = lambda ahead: F.col("x_last") + ahead * F.col("step")
    y = lambda ahead: F.col("y_mean") + F.col("slope") * (at(ahead) - F.col("x_mean"))
    # A line is largest at an end: a series that leaves the bound anywhere is given up as a whole.
    bounded = (F.abs(y(F.lit(1))) <= LARGEST) & (F.abs(y(F.lit(horizon))) <= LARGEST)
    future = join_same(usable, step, keys).filter(bounded).withColumn("ahead", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    return future.withColumns({"__x": at(F.col("ahead")), "__y": y(F.col("ahead"))}).select(
        *keys, "input_rows", "ahead", _label(F.col("kind"), F.col("__x")).alias("label"), F.round("__y", 2).alias("value")
    )
