"""Weekly settlement reports: labelling, splitting, net amounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sellerlens.functions.dates import day_of, iso_day
from sellerlens.functions.pricing import TAX_RATE
from sellerlens.operators import grouping

REPORT = "realizationreport_id"
PERIOD = ["date_from", "date_to"]

# Operation names on settlement lines and the two region labels.
SALE = "Продажа"
RETURN = "Возврат"
HOME, OTHER = "ru", "other"


def typed(lines: DataFrame) -> DataFrame:
    return lines.withColumns({c: day_of(c) for c in PERIOD})


def landed(lines: DataFrame, sequence: str, key: str = "rrd_id") -> DataFrame:
    """Each line once where landed pages overlap: the version with the highest landing sequence.

    The base of every report over paged lines. One row per key and task is left before the shuffle, so
    that it costs one pass over distinct lines; equal sequences are told apart by the whole row. Lines
    without a key can't be told apart and all stay.
    """
    latest = Window.partitionBy(key).orderBy(F.desc(sequence), *[F.desc(c) for c in sorted(lines.columns) if c not in (key, sequence)])
    keyed = lines.where(F.col(key).isNotNull()).withColumn("__nth", F.row_number().over(latest)).where("__nth = 1").drop("__nth")
    return keyed.unionByName(lines.where(F.col(key).isNull()))


# Stands for a missing date while grouping, so that no key is null.
NO_DATE = "0001-01-01"


def _no_date():
    return F.lit(NO_DATE).cast("date")


def _dated(column: str):
    return F.when(F.col(column) != _no_date(), F.col(column))


def _known_period():
    return (F.col(PERIOD[0]) != _no_date()) & (F.col(PERIOD[1]) != _no_date())


def _counts(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    filled = lines.withColumns({c: F.coalesce(F.col(c), _no_date()) for c in PERIOD})
    return (
        grouping.drop_null_keys(filled, *by, REPORT)
        .groupBy(*by, *PERIOD, REPORT)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def report_counts(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lines per report and period; lines without a period belong to none."""
    return _counts(lines, by).where(_known_period())


def report_regions(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per report its region label and the first and last date of its lines.

    The report with most lines of its period is ``ru``, ties going to the smaller id; a report
    in several periods takes the label of the last. The biggest report is found by an aggregate
    and joined back on period, report *and* count: a period shared by very many reports is
    neither sorted in one task nor a join key by itself. With the count among the keys, and no
    key that can be null, both sides ask the same of the lines, which are read and shuffled once. With ``by`` every group of those columns
    (a seller, say) has a biggest report of its own.
    """
    counts = _counts(lines, by)
    biggest = (
        counts.groupBy(*by, *PERIOD)
        .agg(F.max(F.struct("n", (-F.col(REPORT)).alias("neg"))).alias("m"))
        .select(*by, *PERIOD, (-F.col("m.neg")).alias(REPORT), F.col("m.n").alias("n"), F.lit(HOME).alias("region"))
    )
    labelled = counts.join(biggest, [*by, *PERIOD, REPORT, "n"], "left")
    label = F.struct(*PERIOD, F.coalesce("region", F.lit(OTHER)).alias("region"))
    last = F.max(F.when(_known_period(), label)).getField("region")
    return (
        labelled.groupBy(*by, REPORT)
        .agg(
            last.alias("region"),
            F.min(_dated(PERIOD[0])).alias(PERIOD[0]),
            F.max(_dated(PERIOD[1])).alias(PERIOD[1]),
        )
        .where("region IS NOT NULL")
    )


def labels(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return report_regions(lines, by).select(*by, REPORT, "region")


def report_index(lines: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row per report: label, first and last date, and the name its export carries."""
    # Fixed value: the pattern of a report's name.
    name = F.format_string(
        "id_%s_from_%s_to_%s_reg_%s",
        F.col(REPORT).cast("string"),
        iso_day("date_from"),
        iso_day("date_to"),
        F.col("region"),
    )
    return report_regions(lines, by).withColumn("report_name", name)


def labelled_lines(lines: DataFrame, index: DataFrame | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Every line with its report's label.

    The label table has one row per report. Computed here, Spark expects it to be as large as the
    lines and may shuffle them by report; a written ``report_index`` read back has a known size, is
    broadcast where that is small, and the lines stay where they are. Beyond that size it is a
    sort-merge join whose hot report is split at run time.
    """
    known = labels(lines, by) if index is None else index.select(*by, REPORT, "region")
    return lines.join(known, [*by, REPORT])


def operation_total(lines: DataFrame, operation: str, report_type: int = 1) -> DataFrame:
    chosen = lines.where((F.col("report_type") == report_type) & (F.col("supplier_oper_name") == operation))
    return chosen.agg(grouping.total("ppvz_for_pay").alias("amount"))


def net_and_tax(lines: DataFrame, tax_rate: float = TAX_RATE, report_type: int = 1) -> DataFrame:
    """Sales, returns, their difference, the tax on it and the first settled date, in one pass."""
    def of(operation: str):
        hit = (F.col("report_type") == report_type) & (F.col("supplier_oper_name") == operation)
        return F.coalesce(F.sum(F.when(hit, F.col("ppvz_for_pay"))), F.lit(0.0))

    return (
        lines.agg(of(SALE).alias("sales"), of(RETURN).alias("returns"), F.min("date_from").alias("first_date"))
        .withColumn("net", F.col("sales") - F.col("returns"))
        .withColumn("tax", F.col("net") * tax_rate)
    )


def first_date(lines: DataFrame) -> DataFrame:
    return lines.agg(F.min("date_from").alias("first_date"))
