"""Nested feeds to flat rows: struct access, explode and array functions, no shuffle.

``explode_outer`` where a parent with an empty list must survive as one row of nulls, plain
``explode`` where it must vanish.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def suffixed(kind: T.StructType, struct: str, suffix: str, drop: tuple[str, ...] = ()) -> list[Column]:
    """The fields of a struct column, each named with a suffix."""
    return [F.col(f"{struct}.{f}").alias(f + suffix) for f in kind.fieldNames() if f not in drop]


def flatten_struct(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested objects to columns named by their path; arrays stay as they are."""

    def leaves(schema: T.StructType, column, path: str):
        for field in schema.fields:
            here = column(field.name)
            name = f"{path}{separator}{field.name}" if path else field.name
            if isinstance(field.dataType, T.StructType):
                yield from leaves(field.dataType, here.getField, name)
            else:
                yield here.alias(name)

    return df.select(*leaves(df.schema, lambda name: F.col(f"`{name}`"), ""))


def nested_to_json(df: DataFrame, column: str, alias: str | None = None) -> DataFrame:
    return df.select(F.to_json(F.col(column)).alias(alias or column))


# --- campaigns -------------------------------------------------------------------------------

def campaign_list(groups: DataFrame) -> DataFrame:
    """One row per campaign, the fields of its type-and-status group repeated."""
    return (
        groups.select(F.explode("adverts").alias("g"))
        .select("g.type", "g.status", "g.count", F.explode("g.advert_list").alias("a"))
        .select("type", "status", "count", "a.advertId", "a.changeTime")
    )


# Output columns of a campaign.
BASE_FIELDS = (
    "endTime", "createTime", "changeTime", "startTime", "name", "dailyBudget", "advertId",
    "status", "type", "paymentType",
)
# Columns a campaign row gains from whichever of its parameter blocks produced it.
ITEM_FIELDS = {
    "nms": "bigint", "nmCPM": "bigint", "cpm": "bigint", "subjectName": "string",
    "subjectId": "bigint", "auction_nm": "bigint", "auction_bid": "bigint",
    "united_cpm": "bigint", "united_searchCPM": "bigint", "united_subjectName": "string",
    "united_subjectId": "bigint", "united_nms": "string",
}


def _item(**given: Column) -> Column:
    """A struct of all item fields, those not given NULL, so that all blocks share one type."""
    return F.struct(
        *[given.get(f, F.lit(None)).cast(kind).alias(f) for f, kind in ITEM_FIELDS.items()]
    )


def _or_empty(array: Column, kind: str) -> Column:
    return F.coalesce(array, F.array().cast(f"array<{kind}>"))


_BID = "struct<nm: bigint, cpm: bigint>"


# Working columns of ``_with_bids``.
_LISTED, _EXTRA = "__listed", "__extra"


def _heads(entries: str) -> Column:
    """Where each run of equal ``nm`` begins in a sorted array."""
    spots = F.transform(entries, lambda e, i: F.struct(e["nm"].alias("nm"), i.alias("at")))
    return F.filter(spots, lambda h: (h["at"] == 0) | (F.get(F.col(entries), h["at"] - 1)["nm"] != h["nm"]))


def _runs(entries: str, heads: str) -> Column:
    """Map from ``nm`` to where its run begins (``at``) and how long it is (``n``)."""
    def run(h: Column, i: Column) -> Column:
        end = F.coalesce(F.get(F.col(heads), i + 1)["at"], F.size(entries))
        return F.struct(h["at"].alias("at"), (end - h["at"]).alias("n"))

    return F.map_from_arrays(F.transform(heads, lambda h: h["nm"]), F.transform(heads, run))


FEW = 256  # pairs of a product and a bid that are quicker compared than sorted


def _with_bids(campaigns: DataFrame) -> DataFrame:
    """Adds the products of ``autoParams.nms`` with their own bid, and the bids on products not listed, as arrays of ``(nm, cpm)``.

    Products and bids are sorted, bids of one product by their place, so that equal ones are runs and a product's
    last bid ends its run. Maps of the runs have no double keys, and are zipped by hash: apart from the two
    sorts all is linear in a campaign's products and bids. Working columns are each used several times, so that Spark computes
    them once and doesn't write their expressions into the lambdas that use them. Campaigns of up to ``FEW`` pairs search their bids
    product by product, to the same result. A product listed several times is given as often. Bids without a
    product are nobody's, and a listed null has no bid.
    """
    auto = F.col("autoParams")
    listed = _or_empty(auto["nms"], "bigint")
    bids = F.filter(_or_empty(auto["nmCPM"], _BID), lambda b: b["nm"].isNotNull())
    pair = lambda nm, cpm: F.struct(nm.alias("nm"), cpm.alias("cpm"))
    many = F.size(listed).cast("bigint") * F.size(_or_empty(auto["nmCPM"], _BID)) > FEW
    place = lambda b, i: F.struct(b["nm"].alias("nm"), i.alias("i"), b["cpm"].alias("cpm"))
    work = campaigns.withColumns({
        "__bids": F.when(many, F.array_sort(F.transform(bids, place))),
        "__nms": F.when(many, F.transform(F.array_sort(F.array_compact(listed)), lambda nm: F.struct(nm.alias("nm")))),
    })
    work = work.withColumns({"__bid_heads": F.when(many, _heads("__bids")), "__nm_heads": F.when(many, _heads("__nms"))})
    zipped = F.map_zip_with(
        _runs("__nms", "__nm_heads"), _runs("__bids", "__bid_heads"), lambda nm, mine, run: F.struct(mine.alias("mine"), run.alias("run"))
    )
    work = work.withColumn("__met", F.when(many, F.map_entries(zipped)))

    mine, run = (lambda e: e["value"]["mine"]), (lambda e: e["value"]["run"])
    last = lambda e: F.get(F.col("__bids"), run(e)["at"] + run(e)["n"] - 1)["cpm"]
    own = F.flatten(F.transform(
        F.filter("__met", lambda e: mine(e).isNotNull()), lambda e: F.array_repeat(pair(e["key"], last(e)), mine(e)["n"])))
    unnamed = F.transform(F.filter(listed, lambda nm: nm.isNull()), lambda nm: pair(nm, F.lit(None).cast("bigint")))
    extra = F.flatten(F.transform(
        F.filter("__met", lambda e: mine(e).isNull()),
        lambda e: F.transform(F.slice("__bids", run(e)["at"] + 1, run(e)["n"]), lambda b: pair(b["nm"], b["cpm"]))))

    searched = F.transform(listed, lambda nm: pair(
        nm, F.try_element_at(F.filter(auto["nmCPM"], lambda b: b["nm"] == nm), F.lit(-1))["cpm"]))
    unlisted = F.transform(F.filter(bids, lambda b: ~F.coalesce(F.array_contains(listed, b["nm"]), F.lit(False))), lambda b: pair(b["nm"], b["cpm"]))
    return work.withColumns({
        _LISTED: F.when(many, F.concat(own, unnamed)).otherwise(searched), _EXTRA: F.when(many, extra).otherwise(unlisted),
    }).select(*campaigns.columns, _LISTED, _EXTRA)


def _auto_items() -> tuple[Column, Column]:
    """Listed products with their own bid if one exists, then bids of products not listed."""
    auto = F.col("autoParams")
    shared = {
        "cpm": auto["cpm"],
        "subjectName": auto["subject"]["name"],
        "subjectId": auto["subject"]["id"],
    }
    item = lambda b: _item(nms=b["nm"], nmCPM=b["cpm"], **shared)
    return F.transform(_LISTED, item), F.transform(_EXTRA, item)


def _united_items() -> Column:
    def with_names(block: Column) -> Column:
        products = _or_empty(block["nms"], "bigint")
        names = F.array_join(F.transform(products, lambda nm: nm.cast("string")), ", ")
        return F.struct(block.alias("block"), products.alias("products"), names.alias("names"))

    def per_block(pair: Column) -> Column:
        block, products, joined = pair["block"], pair["products"], pair["names"]
        return F.transform(
            products,
            lambda nm: _item(
                nms=nm,
                united_cpm=block["catalogCPM"],
                united_searchCPM=block["searchCPM"],
                united_subjectName=block["subject"]["name"],
                united_subjectId=block["subject"]["id"],
                united_nms=joined,
            ),
        )

    # The names are joined once per block, outside the lambda over its products.
    return F.flatten(F.transform(F.transform(F.col("unitedParams"), with_names), per_block))


def _auction_items() -> Column:
    return F.transform(
        F.col("auction_multibids"), lambda b: _item(auction_nm=b["nm"], auction_bid=b["bid"])
    )


def campaign_rows(campaigns: DataFrame) -> DataFrame:
    """Campaigns to rows, one per listed product, extra bid, united product and auction bid.

    All blocks of a campaign become arrays of one type and are concatenated, so the whole is a
    single scan without a union. A campaign none of whose blocks yields anything keeps one row.
    """
    kind = "struct<" + ", ".join(f"{f}: {k}" for f, k in ITEM_FIELDS.items()) + ">"
    blocks = [*_auto_items(), _united_items(), _auction_items()]
    items = F.concat(*[_or_empty(b, kind) for b in blocks])
    return (
        _with_bids(campaigns).select(*BASE_FIELDS, F.explode_outer(items).alias("__item"))
        .select(*BASE_FIELDS, *[F.col("__item")[f].alias(f) for f in ITEM_FIELDS])
    )


def extra_bids(campaigns: DataFrame) -> DataFrame:
    """Bids on products their campaign does not list."""
    return _with_bids(campaigns).select("advertId", F.explode(_EXTRA).alias("b")).select("advertId", "b.nm", "b.cpm")


def campaigns_filtered(campaigns: DataFrame, status: int | None = None, type: int | None = None) -> DataFrame:
    for column, value in (("status", status), ("type", type)):
        if value is not None:
            campaigns = campaigns.where(F.col(column) == F.lit(value))
    return campaigns


# Names of the listing orders.
CAMPAIGN_ORDER = {"create": "createTime", "change": "changeTime", "id": "advertId"}


def campaigns_ordered(campaigns: DataFrame, order: str = "create", direction: str = "desc") -> DataFrame:
    if order not in CAMPAIGN_ORDER or direction not in ("asc", "desc"):
        raise ValueError(f"order {order!r} {direction!r}: expected one of {tuple(CAMPAIGN_ORDER)}, asc or desc")
    by = F.col(CAMPAIGN_ORDER[order])
    return campaigns.orderBy(by.desc() if direction == "desc" else by.asc(), F.col("advertId"))


# --- phrases ---------------------------------------------------------------------------------

def cluster_counts(words: DataFrame) -> DataFrame:
    return words.select(F.explode("clusters").alias("c")).select("c.cluster", "c.count")


def cluster_keywords(words: DataFrame) -> DataFrame:
    return words.select(F.explode("clusters").alias("c")).select(
        "c.cluster", F.explode_outer("c.keywords").alias("keyword")
    )


def excluded_words(words: DataFrame) -> DataFrame:
    return words.select(
        F.col("words.fixed").alias("fixed"), F.explode("words.excluded").alias("excluded")
    )


def word_lists(words: DataFrame) -> list[str]:
    """Names of the lists a search campaign's words come in."""
    return words.schema["words"].dataType.fieldNames()


def keyword_lines(stats: DataFrame) -> DataFrame:
    """One row per entry of ``stats`` with the fields of its parent, be that a day or a keyword."""
    entry = stats.schema["keywords"].dataType.elementType
    parent = [f for f in entry.fieldNames() if f != "stats"]
    return (
        stats.select(F.explode("keywords").alias("k"))
        .select(*[f"k.{f}" for f in parent], F.explode_outer("k.stats").alias("s"))
        .select(*parent, "s.*")
    )


# --- warehouse remains -----------------------------------------------------------------------

# Columns of a remains row.
REMAINS_FIELDS = (
    "brand", "subjectName", "vendorCode", "nmId", "barcode", "techSize", "volume",
    "inWayToClient", "inWayFromClient", "quantityWarehousesFull",
)


def remains_rows(remains: DataFrame) -> DataFrame:
    """One row per product and warehouse; a product in no warehouse has none."""
    return remains.select(F.explode("warehouses").alias("w"), *REMAINS_FIELDS).select(
        "w.*", *REMAINS_FIELDS
    )
