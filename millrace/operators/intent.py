"""What a question asks for: facts, products, places and dates in shop questions; metrics, statements and scopes in financial ones."""

from __future__ import annotations

import re

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.text import let

from .verify import half_width

# The names that questions use, and the patterns of codes, dates and question words.
FACTS = {
    "price": ("价格", "售价", "单价", "多少钱", "price"),
    "inventory_quantity": ("库存数量", "现货数量", "库存", "inventory quantity", "stock quantity", "inventory", "stock"),
    "delivery_duration": ("配送时长", "交付时长", "送达时间", "配送时间", "物流时效", "delivery"),
    "customs_duty_rate": ("关税税率", "关税率", "进口税率", "customs duty", "duty rate"),
}
NOT_INVENTORY = ("库存费", "库存周转", "inventory fee", "inventory turnover")
LOOSE_INVENTORY = ("库存", "inventory")
TABLES = {
    "product_catalog": ("商品目录", "SKU", "产品", "商品"), "platform_listing": ("平台商品", "店铺商品", "平台", "marketplace"),
    "shipping_policy": ("配送政策", "物流时效", "配送", "delivery"), "customs_policy": ("关税表", "进口税率", "关税", "customs"),
}
PLATFORMS = ("天猫", "淘宝", "京东", "拼多多", "抖音", "Amazon", "亚马逊", "eBay", "Shopee", "Lazada", "AliExpress", "速卖通")
MARKETS = {"中国": ("中国", "中国大陆", "国内", "CN"), "美国": ("美国", "US", "USA"), "英国": ("英国", "UK"), "欧盟": ("欧盟", "EU"), "中国香港": ("中国香港", "香港", "HK"), "日本": ("日本", "JP"), "新加坡": ("新加坡", "SG")}
SKU = r"(?i)(SKU\s*(?:编号|编码|ID)?\s*[:：#-]?\s*[A-Z0-9][A-Z0-9._-]{1,63})"
# an amount is no date: a year and a dot with what is no month behind it, or a bare year or year and month beside a currency or unit of its own
_MONEY, _UNIT = r"(?i:HK\$|CNY|RMB|USD|HKD|人民币|美元|港币|[￥¥$])", r"(?:元(?!旦)|(?i:business\s+days?|hours?|days?)|个?工作日|小时|[%％])"
_BARE = r"20\d{2}(?:\.\d{1,2})?(?!\d|[-/.月]\d)"
_AMOUNT = rf"(?!20\d{{2}}\.(?!(?:0?[1-9]|1[0-2])(?!\d))\d)(?!(?<=(?<!\d\s?){_MONEY}\s{{0,2}}){_BARE}(?!年))(?!{_BARE}\s*(?:{_UNIT}|{_MONEY}(?!\s*[+-]?\d)))"
# digits of a code that goes on with a letter are no year: SKU-2045X
_CODE = r"(?!(?<=(?i:SKU)\s{0,2}(?:编号|编码|(?i:ID))?\s{0,2}[:：#-]?\s{0,2})20\d{2}[A-Za-z_])"
DATE = rf"(?<!\d){_AMOUNT}{_CODE}(20\d{{2}})(?:[-/.年](\d{{1,2}})(?:[-/.月](\d{{1,2}})日?)?)?(?!\d)"
NOISE = r"^(?:请问|请查询|查询|根据|截至|在|该|这个|这款)+|(?:的)?(?:价格|售价|单价|多少钱|库存数量|现货数量|配送时长|交付时长|配送时间|送达时间|物流时效|关税税率|关税率|进口税率)?(?:是多少|有多少|需要多久|多久|吗|呢)[？?]?$"
PUNCTUATION = r"[，。？?：:；;（）()、]"
METRICS = {
    "营业收入": ("营业收入", "营业收入合计", "其中：营业收入"), "净利润": ("净利润",),
    "归母净利润": ("归属于母公司股东的净利润", "归属于母公司所有者的净利润", "归属于本行股东的净利润", "本行股东的净利润"),
    "经营现金流": ("经营活动产生的现金流量净额",), "资产合计": ("资产合计", "资产总计"), "负债合计": ("负债合计", "负债总计"), "毛利率": ("毛利率",),
}
STATEMENTS = {"利润表": ("利润表",), "资产负债表": ("资产负债表",), "现金流量表": ("现金流量表",), "毛利率表": ("毛利率", "分行业", "分产品")}
SCOPES = {
    "合并": r"合并(?:口径|财务报表|报表|利润表|资产负债表|现金流量表)?", "集团": r"集团(?:口径|财务报表|报表|利润表|资产负债表|现金流量表)",
    "母公司": r"母公司(?:口径|财务报表|报表|利润表|资产负债表|现金流量表)", "本行": r"本行(?:口径|财务报表|报表)",
}
COMPANIES = ("海尔智家", "格力电器", "美的集团", "贵州茅台", "五粮液", "比亚迪", "招商银行")
COMPANY_SUFFIXES = ("集团股份有限公司", "股份有限公司", "有限责任公司", "有限公司")
COMPANY_NOISE = r"^(?:请问|请查询|查询|根据|截至|在|该|报告期内)+|(?:的)?(?:年度报告|年报)$"
UNSUPPORTED_SPECS = ("重量", "尺寸", "长宽高", "功率", "电压", "电流", "容量", "规格", "瓦", "伏", "weight", "dimension", "watt", "voltage", "ampere")
FORMULAS = ("计算", "推导", "换算", "估算", "预测", "加权", "公式")

_STRINGS, _SPANS = "array<string>", "array<struct<start:int,stop:int>>"


def places(text: Column, names: dict[str, tuple[str, ...]], skip: Column | None = None, loose: tuple[str, ...] = ()) -> Column:
    """Every place of every alias as struct(neg, start, kind, stop), longest aliases first, then the earliest; `loose` aliases do not count where `skip` holds."""
    found = []
    for kind, aliases in names.items():
        for alias in aliases:
            n = len(alias)
            at = F.filter(F.sequence(F.lit(1), F.greatest(F.length(text) - n + 1, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)) == alias)
            # most aliases are not there, and looking at every place is what costs
            at = F.when(text.contains(alias), at).otherwise(F.array().cast("array<int>"))
            one = F.transform(at, lambda i: F.struct(F.lit(-n).alias("neg"), i.alias("start"), F.lit(kind).alias("kind"), (i + n).alias("stop")))
            found.append(F.when(skip, F.slice(one, 1, 0)).otherwise(one) if alias in loose else one)
    return F.array_sort(F.concat(*found))


def kinds(found: Column) -> Column:
    """Kinds of the places that are left if each one, in order, takes its characters."""
    none = F.struct(F.array().cast(_STRINGS).alias("kinds"), F.array().cast(_SPANS).alias("taken"))

    def step(acc: Column, p: Column) -> Column:
        clash = F.exists(acc["taken"], lambda t: (p["start"] < t["stop"]) & (t["start"] < p["stop"]))
        span = F.array(F.struct(p["start"].alias("start"), p["stop"].alias("stop"))).cast(_SPANS)
        more = F.struct(F.array_union(acc["kinds"], F.array(p["kind"])).alias("kinds"), F.concat(acc["taken"], span).alias("taken"))
        return F.when(clash, acc).otherwise(more)

    return F.aggregate(found, none, step)["kinds"]


def blanked(text: Column, found: Column) -> Column:
    """The text with blanks in the places found."""

    def one(b: Column) -> Column:
        at = F.sequence(F.lit(1), F.greatest(F.length(b["text"]), F.lit(1)))
        return F.array_join(F.transform(at, lambda i: F.when(F.exists(b["found"], lambda p: (p["start"] <= i) & (i < p["stop"])), " ").otherwise(F.substr(b["text"], i, F.lit(1)))), "")

    return let(F.struct(text.alias("text"), found.alias("found")), one)


def _named(names: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*[F.when(hit, F.lit(n)) for n, hit in names.items()]))


def contains_any(text: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def dates(text: Column) -> Column:
    """Distinct dates as yyyy, yyyy-mm or yyyy-mm-dd, in their order."""
    part = lambda x, i: F.lpad(F.regexp_extract(x, DATE, i), 2, "0")
    given = lambda x, i: F.regexp_extract(x, DATE, i) != ""
    one = lambda x: F.concat_ws("-", F.regexp_extract(x, DATE, 1), F.when(given(x, 2), part(x, 2)), F.when(given(x, 3), part(x, 3)))
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(DATE), F.lit(0)), one))


def market_named(text: Column, alias: str) -> Column:
    """Latin names need other characters than letters around them."""
    return text.rlike(rf"(?i)(?<![A-Za-z])\Q{alias}\E(?![A-Za-z])") if re.search("[A-Za-z]", alias) else text.contains(alias)


def _of_first(found: Column, chosen: Column) -> Column:
    return let(F.get(chosen, F.lit(0)), lambda first: F.filter(found, lambda p: p["kind"] == first))


_BUILT: dict[tuple, Column] = {}


def _once(kind: str, question: Column, build) -> Column:
    """build(question), made once for a column given by its bare name: these expressions take seconds to put together."""
    node = question._jc.node() if hasattr(question, "_jc") else None
    if node is None or node.getClass().getSimpleName() != "UnresolvedAttribute" or not node.planId().isEmpty():
        return build(question)
    key = (kind, SparkContext._active_spark_context.applicationId, str(question))
    if key not in _BUILT:
        _BUILT[key] = build(question)
    return _BUILT[key]


def shop_intent(question: Column) -> Column:
    """struct of skus, dates, platforms, markets, product_terms, table_types, fact_types, answer_type, table_fact of a shop question.

    Full-width forms count as plain ones. Where aliases overlap the longest counts; more than one fact type, or
    none, makes the answer type `unsupported`. A null question asks for nothing.
    """
    return _once("shop", question, _shop)


def _shop(question: Column) -> Column:
    return let(F.trim(half_width(F.coalesce(question, F.lit("")))), lambda t: let(F.lower(t), lambda low: let(_facts(low), lambda f: _shop_intent(t, low, f))))


def _facts(low: Column) -> Column:
    return kinds(let(contains_any(low, NOT_INVENTORY), lambda skip: places(low, FACTS, skip, LOOSE_INVENTORY)))


def _shop_intent(text: Column, low: Column, facts: Column) -> Column:
    tables = _named({k: contains_any(low, [a.lower() for a in v]) for k, v in TABLES.items()})
    bare = F.regexp_replace(text, SKU, " ")
    here = lambda b: blanked(b, _of_first(let(F.lower(b), lambda x: places(x, FACTS, contains_any(low, NOT_INVENTORY), LOOSE_INVENTORY)), facts))
    left = F.regexp_replace(let(bare, here), DATE, " ")
    for word in (*PLATFORMS, *[a for names in MARKETS.values() for a in names]):
        left = F.regexp_replace(left, rf"(?i)\Q{word}\E", " ")
    clean = lambda x: F.regexp_replace(F.trim(F.regexp_replace(x, NOISE, "")), "(?:的|商品|产品|这款|该款)$", "")
    terms = F.transform(F.split(F.regexp_replace(left, PUNCTUATION, " "), r"\s+"), clean)
    terms = F.filter(terms, lambda x: F.length(x).between(2, 64) & ~x.isin("平台", "市场", "日期"))
    fields = {
        "skus": F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(SKU), F.lit(1)), F.upper)), "dates": dates(text),
        "platforms": _named({p: low.contains(p.lower()) for p in PLATFORMS}), "markets": _named({m: F.greatest(*[market_named(text, a) for a in v]) for m, v in MARKETS.items()}),
        "product_terms": F.array_distinct(F.slice(terms, 1, 3)), "table_types": tables, "fact_types": facts,
        "answer_type": F.when(F.size(facts) == 1, F.get(facts, F.lit(0))).otherwise("unsupported"), "table_fact": (F.size(facts) > 0) | (F.size(tables) > 0),
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def _company(x: Column) -> Column:
    """A company's name without report words and legal form; null where it is none."""
    return let(_company_name(x), lambda n: F.when(F.length(n).between(2, 16) & ~n.isin("母公司", "本公司", "该公司", "公司", "集团", "本行") & ~contains_any(n, ("年度归属于", "归属于母", "是多少", "金额")), n))


def _company_name(x: Column) -> Column:
    x = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, r"\s+", ""), r"20\d{2}(?:年|年度)?$", ""), COMPANY_NOISE, "")
    for suffix in COMPANY_SUFFIXES:
        x = F.regexp_replace(x, suffix + "$", "")
    return x


def financial_intent(question: Column) -> Column:
    """struct of company_terms, years, metric_families, statement_types, scopes, answer_type, table_fact of a financial question.

    A longer metric takes the characters of a shorter one in it; scope words inside a metric or a company's name do not count.
    """
    return _once("financial", question, _financial)


def _financial(question: Column) -> Column:
    return let(F.trim(half_width(F.coalesce(question, F.lit("")))), lambda t: let(places(t, METRICS), lambda p: let(kinds(p), lambda k: let(blanked(t, _of_first(p, k)), lambda plain: _financial_intent(t, k, plain)))))


def _financial_intent(text: Column, families: Column, plain: Column) -> Column:
    outside = plain
    for c in COMPANIES:
        outside = F.regexp_replace(outside, c, " " * len(c))
    scopes = {s: outside.rlike(p) for s, p in SCOPES.items()}
    group = contains_any(text, [c + "集团" for c in COMPANIES if not c.endswith("集团")])
    scope_list = _named(scopes)
    scope_list = F.when(group & ~scopes["集团"], F.array_append(scope_list, F.lit("集团"))).otherwise(scope_list)
    statements = _named({s: contains_any(text, v) for s, v in STATEMENTS.items()})
    left = plain
    for p in (*SCOPES.values(), *[a for v in STATEMENTS.values() for a in v]):
        left = F.regexp_replace(left, p, " ")
    left = F.regexp_replace(F.regexp_replace(left, r"(?<!\d)20\d{2}(?:年|年度)?(?!\d)", " "), PUNCTUATION, " ")
    return let(left, lambda x: _financial_fields(text, families, statements, scope_list, x))


def _financial_fields(text: Column, families: Column, statements: Column, scope_list: Column, left: Column) -> Column:
    legal = F.transform(F.regexp_extract_all(left, F.lit("([一-鿿]{2,24})(" + "|".join(COMPANY_SUFFIXES) + ")"), F.lit(0)), _company)
    word = lambda x: F.when(~contains_any(x, ("利润表", "资产负债表", "现金流量表", "口径", "报告")), x)
    words = F.transform(F.filter(F.split(left, r"\s+"), lambda x: x != ""), lambda x: word(_company(x)))
    known = _named({c: text.contains(c) for c in COMPANIES})
    ratio = contains_any(text, ("毛利率", "比例", "%"))
    fields = {
        "company_terms": F.when(F.size(known) > 0, known).otherwise(F.array_distinct(F.slice(F.array_compact(F.concat(legal, words)), 1, 2))),
        "years": F.array_distinct(F.regexp_extract_all(text, F.lit(r"(?<!\d)(20\d{2})(?!\d)"), F.lit(1))), "metric_families": families, "statement_types": statements, "scopes": scope_list,
        "answer_type": F.when(ratio, "ratio").otherwise("amount"), "table_fact": (F.size(families) > 0) | (F.size(statements) > 0) | ratio,
    }
    return F.struct(*[c.alias(n) for n, c in fields.items()])


def question_preflight(question: Column, intent: Column) -> Column:
    """Why a question can't be answered from one fact, or null where it can."""
    low = F.lower(half_width(F.coalesce(question, F.lit(""))))
    return let(F.size(intent["fact_types"]), lambda n: _preflight(low, n))


def shop_preflight(question: Column) -> Column:
    """question_preflight of a shop question from its facts alone, without the rest of its intent."""
    text = half_width(F.coalesce(question, F.lit("")))
    return let(F.size(let(F.lower(F.trim(text)), _facts)), lambda n: _preflight(F.lower(text), n))


def _preflight(low: Column, n: Column) -> Column:
    return F.when(contains_any(low, UNSUPPORTED_SPECS), "unsupported_fact_type").when(contains_any(low, FORMULAS), "unsupported_complex_formula").when(n == 0, "unsupported_fact_type").when(n > 1, "unsupported_multi_fact")
