"""Advertising statistics: flattening, costs per campaign, product and article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sellerlens.functions import dates
from sellerlens.functions.pricing import margin, percent, ratio
from sellerlens.operators import grouping, nested, ranking

# Figures and key of an ad line.
NM_SUMS = ["sum_nm", "views_nm", "clicks_nm", "orders_nm", "sum_price_nm"]
LINE_KEY = ["date_day", "advertId", "appType_device", "nmId_nm"]
LINE_ORDER = ["chunk_seq", "day_pos", "app_pos", "nm_pos"]


# --- flattening ------------------------------------------------------------------------------

def ad_lines(chunks: DataFrame) -> DataFrame:
    """Chunks to one row per campaign, day, device and product, fields suffixed by their level.

    Every level is an outer explode: a day without devices or a device without products stays as
    one row of nulls. The chunks are exploded as they are; a campaign's days are never gathered
    in one place first. Positions keep the arrival order for ``keep first``.
    """
    day = chunks.schema["days"].dataType.elementType
    device = day["apps"].dataType.elementType
    product = device["nm"].dataType.elementType

    origin = ["advertId", "chunk_seq"]
    days = chunks.select(*origin, F.posexplode_outer("days").alias("day_pos", "day"))
    day_columns = nested.suffixed(day, "day", "_day", drop=("apps",))
    devices = days.select(
        *origin, "day_pos", *day_columns, F.posexplode_outer("day.apps").alias("app_pos", "device")
    ).withColumn("date_day", iso_day("date_day"))
    products = devices.select(
        "*",
        *nested.suffixed(device, "device", "_device", drop=("nm",)),
        F.posexplode_outer("device.nm").alias("nm_pos", "product"),
    )
    return products.select("*", *nested.suffixed(product, "product", "_nm")).drop("device", "product")


def iso_day(column: str) -> Column:
    """The calendar day an ISO text names, whatever time and offset follow; bad text is an error."""
    return F.to_date(F.substring(column, 1, 10)).cast("string")


def booster_lines(chunks: DataFrame) -> DataFrame:
    booster = chunks.schema["boosterStats"].dataType.elementType
    lines = chunks.select(
        "advertId", "chunk_seq", F.posexplode_outer("boosterStats").alias("booster_pos", "b")
    )
    return lines.select(
        "advertId", "chunk_seq", "booster_pos", *nested.suffixed(booster, "b", "_booster")
    ).withColumn("date_booster", iso_day("date_booster"))


# --- campaign level --------------------------------------------------------------------------

def campaign_rollup(chunks: DataFrame, views: str = "min") -> DataFrame:
    """A campaign's figures over all its chunks.

    ``views="min"`` is what the reports were defined with although every other figure is summed;
    ``views="sum"`` is the consistent reading. The day and booster lists are represented by
    their sizes; their rows come from ``ad_lines`` and ``booster_lines``.
    """
    # Compared as dates: unlike text, a date fits the fixed-width state of a hash aggregate.
    first = F.min(dates.day_of("interval.begin"))
    last = F.max(dates.day_of("interval.end"))
    added = ["clicks", "sum", "orders", "sum_price", "atbs", "shks"]
    size = lambda c: F.sum(F.when(F.col(c).isNull(), 0).otherwise(F.size(c)))
    return grouping.drop_null_keys(chunks, "advertId").groupBy("advertId").agg(
        (F.min("views") if views == "min" else F.sum("views")).alias("views"),
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in added],
        size("days").alias("days"),
        size("boosterStats").alias("boosterStats"),
        first.cast("string").alias("interval_begin"),
        last.cast("string").alias("interval_end"),
    )


def with_rates(rollup: DataFrame) -> DataFrame:
    """Click rate, cost per click and orders per click, NULL where undefined."""
    return rollup.select(
        "*",
        percent("clicks", "views").alias("ctr"),
        ratio("sum", "clicks").alias("cpc"),
        percent("orders", "clicks").alias("cr"),
    )


def with_campaign(lines: DataFrame, chunks: DataFrame, views: str = "min") -> DataFrame:
    """Ad lines beside their campaign's figures and rates, those suffixed ``_campaign``.

    One row per campaign is joined; a line without a campaign keeps NULLs.
    """
    rollup = with_rates(campaign_rollup(chunks, views)).drop("days", "boosterStats")
    named = rollup.withColumnsRenamed({c: f"{c}_campaign" for c in rollup.columns if c != "advertId"})
    return lines.join(named, "advertId", "left")


# --- lines with positions --------------------------------------------------------------------

def first_positions(boosters: DataFrame) -> DataFrame:
    """The first booster row of each campaign and day."""
    order = [c for c in ("chunk_seq", "booster_pos", "nm_booster") if c in boosters.columns]
    return ranking.keep_first(boosters, ["date_booster", "advertId"], order)


def with_position(lines: DataFrame, boosters: DataFrame) -> DataFrame:
    """Ad lines with the average position of their campaign and day.

    Several booster rows may share a campaign and day. All that is ever kept of such a fan-out
    is its first row, so boosters are reduced to that row before the join and no pairs are
    formed. Keys compare null-safe: a line without a date meets a booster row without one.
    """
    first = first_positions(boosters).select(
        F.col("advertId").alias("__advert"), "date_booster",
        *[c for c in boosters.columns if c.endswith("_booster") and c != "date_booster"],
    )
    same = lines["date_day"].eqNullSafe(first["date_booster"]) & lines["advertId"].eqNullSafe(first["__advert"])
    return lines.join(first, same, "left").drop("__advert")


def dedup_lines(lines: DataFrame) -> DataFrame:
    """First line per day, campaign, device and product."""
    return ranking.keep_first(lines, LINE_KEY, [c for c in LINE_ORDER if c in lines.columns])


def cost_lines(chunks: DataFrame) -> DataFrame:
    """Deduplicated ad lines. Costs ask for no position, so that join is left out."""
    return dedup_lines(ad_lines(chunks))


def positioned_lines(chunks: DataFrame) -> DataFrame:
    """Deduplicated ad lines with positions; deduplicating first makes the join smaller."""
    return with_position(cost_lines(chunks), booster_lines(chunks))


def daily_positions(lines: DataFrame, campaign: int | None = None) -> DataFrame:
    """Distinct day figures and position, optionally of one campaign."""
    if campaign is not None:
        lines = lines.where(F.col("advertId") == campaign)
    return lines.select("advertId", "date_day", "views_day", "clicks_day", "avg_position_booster").distinct()


# --- costs -----------------------------------------------------------------------------------

def by_product(lines: DataFrame) -> DataFrame:
    return grouping.sums(lines, ["advertId", "nmId_nm"], NM_SUMS)


def by_spend(costs: DataFrame) -> DataFrame:
    keys = [c for c in ("nmId_nm", "advertId", "supplierArticle") if c in costs.columns]
    return costs.orderBy(F.desc("sum_nm"), *keys)


def with_names(costs: DataFrame, campaigns: DataFrame) -> DataFrame:
    """A campaign known under two names counts under both."""
    names = campaigns.select("advertId", "name").distinct()
    return costs.join(names, "advertId", "left")


def costs_by_article(costs: DataFrame, campaigns: DataFrame, per_product: DataFrame) -> DataFrame:
    """Costs per product and article with the share of spend in ordered value (``drr``).

    Names and campaign ids are those of the highest spend. A product's order value enters once
    per campaign that advertised it. Products without orders have no article and are left out.
    """
    joined = (
        with_names(costs, campaigns)
        .join(per_product, F.col("nmId_nm") == F.col("nmId"), "left")
    )
    named = F.col("name").isNotNull()
    spend_order = (-F.col("sum_nm"), F.col("advertId"))
    per_article = (
        grouping.drop_null_keys(joined, "nmId_nm", "supplierArticle")
        .groupBy("nmId_nm", "supplierArticle")
        .agg(
            *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in NM_SUMS],
            F.coalesce(F.sum("priceWithDisc"), F.lit(0.0)).alias("priceWithDisc"),
            F.min_by("name", F.when(named, F.struct(*spend_order, "name"))).alias("name"),
            F.min_by("advertId", F.struct(*spend_order)).alias("advertId"),
        )
    )
    return per_article.withColumn("drr", percent("sum_nm", "sum_price_nm"))


def spend_vs_orders(lines: DataFrame, per_product: DataFrame) -> DataFrame:
    """Spend and orders per product, products of either side kept."""
    spend = grouping.sums(lines, ["nmId_nm"], ["sum_nm", "sum_price_nm"])
    both = spend.join(per_product, F.col("nmId_nm") == F.col("nmId"), "full_outer")
    return both.withColumn("drr", percent("sum_nm", "sum_price_nm"))


def highest_drr(both: DataFrame, k: int = 20) -> DataFrame:
    return both.orderBy(F.desc_nulls_last("drr"), F.asc_nulls_last("nmId_nm"), F.asc_nulls_last("nmId")).limit(k)


def top_spend(lines: DataFrame, k: int = 5) -> DataFrame:
    spend = grouping.sums(lines, ["nmId_nm"], ["sum_nm"])
    return spend.orderBy(F.desc("sum_nm"), "nmId_nm").limit(k)


def spend_total(costs: DataFrame, article: str | None = None, other_than: str | None = None) -> DataFrame:
    """Spend and ordered value, of all articles, of one, or of all but one (nulls kept)."""
    if article is not None:
        costs = costs.where(F.col("supplierArticle") == article)
    if other_than is not None:
        costs = costs.where(~F.col("supplierArticle").eqNullSafe(F.lit(other_than)))
    return costs.agg(
        grouping.total("sum_nm").alias("spend"), grouping.total("sum_price_nm").alias("ordered")
    )


def margin_estimate(totals: DataFrame) -> DataFrame:
    return totals.withColumn("margin", margin(F.col("ordered")))


def reconcile(chunks: DataFrame) -> DataFrame:
    """The same spend at three stages: as delivered, flattened, deduplicated."""
    day = chunks.schema["days"].dataType.elementType
    device = day["apps"].dataType.elementType
    listed = lambda entry, name, kind: F.coalesce(entry[name], F.array().cast(kind[name].dataType.simpleString()))
    devices = F.flatten(F.transform("days", lambda d: listed(d, "apps", day)))
    products = F.flatten(F.transform(devices, lambda a: listed(a, "nm", device)))
    flattened = F.aggregate(products, F.lit(0.0), lambda acc, n: acc + F.coalesce(n["sum"], F.lit(0.0)))
    # The first two stages need no rows but the chunks, so one pass gives both.
    whole = chunks.select("sum", flattened.alias("flat")).agg(
        grouping.total("sum").alias("delivered"), grouping.total("flat").alias("flattened")
    )
    named = lambda name: F.struct(F.lit(name).alias("stage"), F.col(name).alias("spend"))
    last = dedup_lines(ad_lines(chunks)).agg(grouping.total("sum_nm").alias("spend"))
    return (
        whole.select(F.explode(F.array(named("delivered"), named("flattened"))).alias("s")).select("s.*")
        .unionByName(last.select(F.lit("deduplicated").alias("stage"), "spend"))
    )
