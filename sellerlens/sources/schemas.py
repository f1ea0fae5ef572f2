"""One explicit schema per landed feed; nothing is inferred when a feed has a known shape.

Fields a feed carries beyond these are ignored by the reader, missing ones become NULL.
Timestamps stay ISO strings here because one of them holds a sentinel (``NOT_CANCELLED``) and
ISO text orders like the time it names; operators parse where they need a calendar field.
"""

from __future__ import annotations

from pyspark.sql import types as T

LONG, INT, DOUBLE, TEXT, BOOL = T.LongType(), T.IntegerType(), T.DoubleType(), T.StringType(), T.BooleanType()


def row(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


def many(element: T.DataType) -> T.ArrayType:
    return T.ArrayType(element)


# Fixed value: the feed writes this instead of NULL while an order is not cancelled.
NOT_CANCELLED = "0001-01-01T00:00:00"

ORDERS = row(
    srid=TEXT, date=TEXT, lastChangeDate=TEXT, supplierArticle=TEXT, nmId=LONG, totalPrice=DOUBLE,
    discountPercent=DOUBLE, finishedPrice=DOUBLE, priceWithDisc=DOUBLE, warehouseName=TEXT,
    oblast=TEXT, subject=TEXT, category=TEXT, isRealization=BOOL, cancel_dt=TEXT,
)

SALES = row(
    date=TEXT, lastChangeDate=TEXT, supplierArticle=TEXT, totalPrice=DOUBLE, discountPercent=DOUBLE,
    promoCodeDiscount=DOUBLE, warehouseName=TEXT, subject=TEXT, category=TEXT, regionName=TEXT,
    spp=DOUBLE, forPay=DOUBLE, finishedPrice=DOUBLE, priceWithDisc=DOUBLE, IsStorno=INT,
)

STOCKS = row(supplierArticle=TEXT, quantity=LONG)

CAMPAIGN_LIST = row(
    adverts=many(row(
        type=INT, status=INT, count=LONG,
        advert_list=many(row(advertId=LONG, changeTime=TEXT)),
    ))
)

SUBJECT = row(id=LONG, name=TEXT)

CAMPAIGNS = row(
    advertId=LONG, name=TEXT, type=INT, status=INT, dailyBudget=DOUBLE, paymentType=TEXT,
    createTime=TEXT, changeTime=TEXT, startTime=TEXT, endTime=TEXT,
    autoParams=row(cpm=LONG, subject=SUBJECT, nms=many(LONG), nmCPM=many(row(nm=LONG, cpm=LONG))),
    unitedParams=many(row(catalogCPM=LONG, searchCPM=LONG, subject=SUBJECT, nms=many(LONG))),
    auction_multibids=many(row(nm=LONG, bid=LONG)),
)

# chunk_seq is not part of the payload: the landing step numbers the chunks it writes, so that
# "first in arrival order" keeps a meaning once the files are read in parallel.
AD_FULLSTATS = row(
    chunk_seq=LONG, advertId=LONG, views=LONG, clicks=LONG, orders=LONG, atbs=LONG, shks=LONG,
    sum=DOUBLE, sum_price=DOUBLE, interval=row(begin=TEXT, end=TEXT),
    days=many(row(
        date=TEXT, views=LONG, clicks=LONG, sum=DOUBLE, orders=LONG, sum_price=DOUBLE,
        apps=many(row(
            appType=INT, views=LONG, clicks=LONG, sum=DOUBLE,
            nm=many(row(
                nmId=LONG, name=TEXT, views=LONG, clicks=LONG, sum=DOUBLE, orders=LONG, sum_price=DOUBLE,
            )),
        )),
    )),
    boosterStats=many(row(date=TEXT, nm=LONG, avg_position=DOUBLE)),
)

AUTO_STAT_WORDS = row(clusters=many(row(cluster=TEXT, count=LONG, keywords=many(TEXT))))

STAT_WORDS = row(
    words=row(fixed=BOOL, excluded=many(TEXT), phrase=many(TEXT), strong=many(TEXT), pluse=many(TEXT))
)

KEYWORD_STATS = row(
    keywords=many(row(
        date=TEXT, stats=many(row(keyword=TEXT, views=LONG, clicks=LONG, sum=DOUBLE)),
    ))
)

WAREHOUSE_REMAINS = row(
    brand=TEXT, subjectName=TEXT, vendorCode=TEXT, nmId=LONG, barcode=TEXT, techSize=TEXT,
    volume=DOUBLE, inWayToClient=LONG, inWayFromClient=LONG, quantityWarehousesFull=LONG,
    warehouses=many(row(warehouseName=TEXT, quantity=LONG)),
)

SETTLEMENT = row(
    rrd_id=LONG, realizationreport_id=LONG, date_from=TEXT, date_to=TEXT, report_type=INT,
    supplier_oper_name=TEXT, ppvz_for_pay=DOUBLE,
)

SLOTS = row(
    date=TEXT, coefficient=INT, warehouseID=LONG, warehouseName=TEXT, allowUnload=BOOL,
    boxTypeName=TEXT, boxTypeID=INT, storageCoef=TEXT, deliveryCoef=TEXT, deliveryBaseLiter=TEXT,
    deliveryAdditionalLiter=TEXT, storageBaseLiter=TEXT, storageAdditionalLiter=TEXT,
    isSortingCenter=BOOL,
)

WAREHOUSES = row(ID=LONG, name=TEXT, address=TEXT, workTime=TEXT, acceptsQR=BOOL)

REGISTRY = row(user_id=TEXT, user_api=TEXT, seq=LONG)

FEEDS: dict[str, T.StructType] = {
    "orders": ORDERS,
    "sales": SALES,
    "stocks": STOCKS,
    "campaign_list": CAMPAIGN_LIST,
    "campaigns": CAMPAIGNS,
    "ad_fullstats": AD_FULLSTATS,
    "auto_stat_words": AUTO_STAT_WORDS,
    "stat_words": STAT_WORDS,
    "keyword_stats": KEYWORD_STATS,
    "warehouse_remains": WAREHOUSE_REMAINS,
    "settlement": SETTLEMENT,
    "slots": SLOTS,
    "warehouses": WAREHOUSES,
    "registry": REGISTRY,
}

# Feeds whose columns the callers never name. Their schema is inferred once from landed files
# (``feeds.pin_schema``) and passed in from then on.
UNPINNED_FEEDS = ("incomes", "paid_storage", "goods_return")

# Column lists the reports keep right after loading.
ORDER_COLUMNS = [
    "date", "supplierArticle", "totalPrice", "discountPercent", "warehouseName", "oblast",
    "subject", "category", "cancel_dt",
]
SALES_COLUMNS = [
    "date", "supplierArticle", "totalPrice", "discountPercent", "promoCodeDiscount",
    "warehouseName", "subject", "category", "regionName", "spp", "forPay", "finishedPrice",
    "priceWithDisc", "IsStorno",
]
