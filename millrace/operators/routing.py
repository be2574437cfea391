"""Message routing, after-sales classification and policy as ordered rules and decision-table joins."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Keywords, patterns and decisions that results depend on.
ADDRESS_CHANGE = ("修改地址", "更改地址", "改地址", "换地址", "地址改", "地址换", "地址变更", "修改收货地址", "更改收货地址", "收货地址改", "change address", "change shipping address", "update delivery address")
ADDRESS_TARGET = r"(?:寄到|送到|寄往|配送到|改寄|改送|ship\s+to|deliver\s+to)\s*(?=.{2,})(?:[^，。！？?\n]*?(?:路|街|道|巷|号|室|楼|栋|大厦|公寓|street|st\.?|road|rd\.?|avenue|ave\.?|lane|ln\.?|drive|dr\.?|building|apartment|apt\.?|\d{5,6}|1\d{10}))"
CANCEL = ("取消订单", "取消这个订单", "订单取消", "撤销订单", "取消购买", "不要这个订单", "这个订单不要了", "不想要这个订单", "订单不想要了", "cancel order", "cancel my order", "cancel this order", "cancel the order")
CANCEL_WITH_ORDER = r"(?:取消|撤销|cancel).{0,20}\bvlt-\d{4}-\d{4}\b|\bvlt-\d{4}-\d{4}\b.{0,20}(?:取消|撤销|cancel)"
CANCEL_NEGATION = (r"不要.{0,12}(?:订单号|发票).{0,20}(?:订单.{0,8}(?:保留|不要取消)|保留订单)", r"(?:订单.{0,8}(?:保留|不要取消)|保留订单).{0,20}不要.{0,12}(?:订单号|发票)")
ROUTES = (
    ("unsupported", 0.95, ("股票", "基金", "期货", "证券", "量子力学", "快速排序", "写程序", "写代码", "写一首", "写诗", "天气", "stock price", "programming", "write code", "poem")),
    ("aftersales_handling", 0.90, ("退款", "退货", "换货", "破损", "损坏", "坏了", "错发", "少发", "丢件", "丢失", "延误", "太慢", "投诉", "赔偿", "补偿", "保修", "质保", "refund", "return", "replace", "damaged", "broken", "wrong item", "lost", "delayed", "complaint", "compensation", "warranty")),
    ("logistics_tracking", 0.88, ("物流", "快递", "运单", "包裹", "发货", "到哪", "送到", "送达", "签收", "几号到", "何时到", "shipment", "shipping", "tracking", "track order", "track my order", "track this order", "package", "delivery", "carrier", "arrive", "arrival", "delivered")),
    ("order_query", 0.85, ("订单", "订单状态", "order", "order status")),
    ("product_inquiry", 0.85, ("推荐", "商品", "产品", "价格", "多少钱", "对比", "比较", "参数", "规格", "兼容", "库存", "有货", "充电器", "充电宝", "数据线", "耳机", "适配器", "支架", "recommend", "product", "price", "compare", "spec", "compatible", "stock", "charger", "power bank", "cable", "earbuds", "adapter")),
)
FALLBACK = ("unsupported", 0.70)
ISSUES = (("wrong_item", ("错发", "发错", "错误商品", "wrong item")), ("damaged", ("破损", "损坏", "坏了", "damaged", "broken")), ("lost", ("丢件", "丢失", "没收到", "lost", "missing package")), ("delayed", ("延误", "太慢", "未按时", "delayed", "late")), ("return_request", ("退货", "return")), ("warranty", ("保修", "质保", "warranty")))
ACTIONS = (("refund", ("退款", "refund")), ("replacement", ("换货", "补发", "replacement", "replace")), ("compensation", ("赔偿", "补偿", "compensation")), ("return", ("退货", "return")), ("warranty_service", ("保修", "质保", "warranty")))
ACTION_RULES = (("refund", "refund_review"), ("replacement", "replacement_review"), ("compensation", "compensation_review"), ("cancel", "cancellation_review"), ("return", "return_review"), ("warranty_service", "warranty_review"), ("change_address", "address_change_review"))
# issue, statuses that are eligible (none: any but cancelled), evidence, action without a request
ISSUE_RULES = (
    ("address_change", ("paid", "processing"), (), "manual_resolution_review"),
    ("damaged", (), ("商品或外包装破损照片", "快递面单照片"), "manual_resolution_review"),
    ("wrong_item", (), ("收到商品的 SKU 或标签照片", "外包装面单照片"), "manual_resolution_review"),
    ("lost", (), (), "carrier_investigation"),
    ("delayed", (), (), "carrier_investigation"),
    ("cancel_request", ("paid", "processing"), (), "manual_resolution_review"),
    ("return_request", (), ("商品当前状态说明",), "manual_resolution_review"),
    ("warranty", (), ("故障现象说明", "商品序列号或 SKU"), "manual_resolution_review"),
)
ORDER_NO = r"\bvlt-\d{4}-\d{4}\b"
CATEGORIES = (
    ("wireless_charger", ("无线充电", "wireless charger", "qi2")), ("power_bank", ("充电宝", "移动电源", "power bank")), ("charger", ("充电器", "充电头", "charger")), ("cable", ("数据线", "充电线", "cable")),
    ("hub", ("扩展坞", "集线器", "hub")), ("audio", ("耳机", "earbuds", "headphones")), ("adapter", ("旅行转换器", "旅行适配器", "travel adapter")), ("accessory", ("支架", "stand", "accessory")),
)
_AMOUNT, _CURRENCY = r"(\d{1,3}(?:,\d{3})*(?:\.\d+)?|\d+(?:\.\d+)?)", r"(usd|eur|gbp|[$€£¥￥])"
# pattern, group of the amount, group of the currency (0: none), tried in this order
PRICES = (
    (_AMOUNT + r"\s*元(?:以内|以下|之内)", 1, 0),
    (r"(?:under|below|less than)\s*" + _CURRENCY + r"?\s*" + _AMOUNT, 2, 1),
    (_CURRENCY + r"\s*" + _AMOUNT, 2, 1),
    (_AMOUNT + r"\s*" + _CURRENCY + r"\s*(?:or less|max|以内|以下)", 1, 2),
)
CURRENCY_NAMES = {"usd": "USD", "$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP", "¥": "CNY", "￥": "CNY"}
SKU = r"\b(?:vc|shop-(?:us|eu|uk))-[a-z]{3}-\d{4}\b"


def any_of(low: Column, words: tuple[str, ...]) -> Column:
    return low.rlike("|".join(re.escape(w) for w in words))


def first_rule(low: Column, rules, otherwise: str) -> Column:
    """Name of the first rule with a word in the text."""
    out = None
    for name, words in rules:
        out = F.when(any_of(low, words), name) if out is None else out.when(any_of(low, words), name)
    return out.otherwise(otherwise)


def flags(messages: DataFrame) -> DataFrame:
    """address_change and explicit_cancel; keeping the order in so many words is no cancellation."""
    low = F.lower("message")
    kept = low.rlike(CANCEL_NEGATION[0]) | low.rlike(CANCEL_NEGATION[1])
    return messages.withColumn("address_change", any_of(low, ADDRESS_CHANGE) | low.rlike(ADDRESS_TARGET)).withColumn("explicit_cancel", ~kept & (any_of(low, CANCEL) | low.rlike(CANCEL_WITH_ORDER)))


def route_messages(messages: DataFrame, rules=ROUTES, fallback=FALLBACK) -> DataFrame:
    """messages(message, ...) with route and confidence. Empty messages are unsupported for certain."""
    low = F.trim(F.lower("message"))
    rows = flags(messages)
    local = F.col("address_change") | F.col("explicit_cancel")
    out = F.when(low == "", F.struct(F.lit("unsupported").alias("route"), F.lit(1.0).alias("confidence"))).when(local, F.struct(F.lit("aftersales_handling").alias("route"), F.lit(0.95).alias("confidence")))
    for route, sure, words in rules:
        out = out.when(any_of(low, words), F.struct(F.lit(route).alias("route"), F.lit(sure).alias("confidence")))
    out = out.otherwise(F.struct(F.lit(fallback[0]).alias("route"), F.lit(fallback[1]).alias("confidence")))
    return rows.withColumn("__r", out).withColumn("route", F.col("__r.route")).withColumn("confidence", F.col("__r.confidence")).drop("__r")


def order_no(message: Column) -> Column:
    got = F.upper(F.regexp_extract(F.lower(message), ORDER_NO, 0))
    return F.when(got != "", got)


def catalog_filters(messages: DataFrame) -> DataFrame:
    """Category, price cap and its currency, watts and SKU asked for; the first price pattern that fits counts."""
    low = F.lower("message")
    price = currency = None
    names = F.create_map(*[F.lit(x) for kv in CURRENCY_NAMES.items() for x in kv])
    for pattern, amount, cur in PRICES:
        hit = low.rlike(pattern)
        value = F.replace(F.regexp_extract(low, pattern, amount), F.lit(","), F.lit("")).try_cast("decimal(12,2)")
        unit = names[F.regexp_extract(low, pattern, cur)] if cur else F.lit(None).cast("string")
        price = F.when(hit, value) if price is None else price.when(hit, value)
        currency = F.when(hit, unit) if currency is None else currency.when(hit, unit)
    watts, sku = F.regexp_extract(low, r"(\d{1,3})\s*(?:w|瓦)", 1), F.upper(F.regexp_extract(low, SKU, 0))
    cat = first_rule(low, CATEGORIES, "")
    return messages.select(*messages.columns, F.when(cat != "", cat).alias("category"), price.alias("max_price"), currency.alias("budget_currency"), watts.try_cast("int").alias("power_w"), F.when(sku != "", sku).alias("sku"))


def aftersales_classify(messages: DataFrame, issues=ISSUES, actions=ACTIONS) -> DataFrame:
    low = F.lower("message")
    rows = flags(messages)
    pick = lambda address, cancel, rules, other: F.when(F.col("address_change"), address).when(F.col("explicit_cancel"), cancel).otherwise(first_rule(low, rules, other))
    return rows.withColumn("issue_type", pick("address_change", "cancel_request", issues, "other")).withColumn("requested_action", pick("change_address", "cancel", actions, "investigate"))


def rule_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    a = spark.createDataFrame(list(ACTION_RULES), "requested_action string, review string")
    i = spark.createDataFrame([(n, list(s), list(e), d) for n, s, e, d in ISSUE_RULES], "issue_type string, eligible_statuses array<string>, required_evidence array<string>, default_action string")
    return a, i


def aftersales_policy(requests: DataFrame, actions: DataFrame, issues: DataFrame) -> DataFrame:
    """requests(issue_type, requested_action, order_status) joined to the two rule tables (a few rows each)."""
    rows = requests.join(F.broadcast(actions), "requested_action", "left").join(F.broadcast(issues), "issue_type", "left")
    open_ = F.when(F.coalesce(F.size("eligible_statuses"), F.lit(0)) > 0, F.array_contains("eligible_statuses", F.col("order_status"))).otherwise(F.col("order_status") != "cancelled")
    rows = rows.withColumn("eligible_for_review", open_)
    action = F.when(~F.col("eligible_for_review"), "manual_resolution_review").otherwise(F.coalesce("review", "default_action", F.lit("manual_resolution_review")))
    return rows.select(*requests.columns, action.alias("proposed_action"), "eligible_for_review", F.coalesce("required_evidence", F.array().cast("array<string>")).alias("required_evidence"), F.concat(F.lit("V1-"), F.upper("issue_type")).alias("policy_code"))


def audit_events(routed: DataFrame) -> DataFrame:
    """One audit row per message: lengths and route, never the text."""
    return routed.select("request_id", F.lit("chat").alias("action"), F.to_json(F.struct(F.length("message").alias("message_length"))).alias("input_summary"), F.to_json(F.struct("route", "confidence")).alias("result_summary"))
