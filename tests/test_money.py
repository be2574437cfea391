"""Which statements keep money within market and currency."""

import pytest

from millrace.operators import money, scope

KEYS = "marketplace, currency"
ACCEPTED = [
    f"SELECT {KEYS}, sku, SUM(gross_sales) AS sales FROM sales_records GROUP BY {KEYS}, sku",
    f"SELECT {KEYS}, sku, RANK() OVER (PARTITION BY {KEYS} ORDER BY operating_contribution DESC) FROM sales_records",
    "SELECT sku, SUM(units_sold), COUNT(gross_sales), MAX(gross_sales) FROM sales_records GROUP BY sku",
    "SELECT m, c, SUM(net) FROM (SELECT marketplace AS m, upper(currency) AS c, gross_sales - refunds AS net FROM sales_records) GROUP BY m, c",
    f"WITH a AS (SELECT * FROM sales_records), b AS (SELECT {KEYS}, SUM(gross_sales) AS x FROM a GROUP BY {KEYS}) SELECT *, ROW_NUMBER() OVER (PARTITION BY {KEYS} ORDER BY x) FROM b",
    f"SELECT sku, SUM(gross_sales) OVER (PARTITION BY {KEYS}, sku) FROM sales_records",
    f"SELECT {KEYS}, SUM(g) FROM (SELECT {KEYS}, gross_sales AS g FROM sales_records UNION ALL SELECT {KEYS}, refunds FROM sales_records) GROUP BY {KEYS}",
    "SELECT sku, ROW_NUMBER() OVER (ORDER BY units_sold) FROM sales_records",
    f"SELECT {KEYS}, SUM(gross_sales) FROM sales_records GROUP BY GROUPING SETS (({KEYS}), ({KEYS}, sku))",
]
REFUSED = [
    "SELECT sku, SUM(gross_sales) AS sales FROM sales_records GROUP BY sku",
    f"SELECT {KEYS}, sku, RANK() OVER (ORDER BY operating_contribution DESC) FROM sales_records",
    "SELECT sum(gross_sales) FROM sales_records", "SELECT currency, AVG(refunds) FROM sales_records GROUP BY currency", "SELECT sum(CASE WHEN units_sold > 1 THEN cogs ELSE 0 END) FROM sales_records",
    "SELECT SUM(x) FROM (SELECT gross_sales * 2 AS x FROM sales_records)", "WITH a AS (SELECT gross_sales AS x FROM sales_records), b AS (SELECT x + 1 AS y FROM a) SELECT avg(y) FROM b",
    f"SELECT SUM(s) FROM (SELECT {KEYS}, SUM(gross_sales) AS s FROM sales_records GROUP BY {KEYS})", f"SELECT {KEYS}, SUM(gross_sales) FROM sales_records GROUP BY ROLLUP ({KEYS})", f"SELECT {KEYS}, SUM(gross_sales) FROM sales_records GROUP BY CUBE ({KEYS})",
    "SELECT SUM(gross_sales) FROM sales_records GROUP BY length(currency), marketplace", "SELECT 'x' AS currency, 'y' AS marketplace, SUM(gross_sales) FROM sales_records GROUP BY 1, 2",
    "SELECT sku FROM sales_records WHERE gross_sales > (SELECT AVG(gross_sales) FROM sales_records)", "SELECT sku FROM sales_records s WHERE EXISTS (SELECT SUM(refunds) FROM sales_records t WHERE t.sku = s.sku HAVING SUM(refunds) > 0)",
    "SELECT sku, DENSE_RANK() OVER (PARTITION BY currency ORDER BY gross_sales) FROM sales_records", "SELECT SUM(gross_sales) OVER (PARTITION BY sku) FROM sales_records", f"SELECT {KEYS}, SUM(g) FROM (SELECT {KEYS}, gross_sales AS g FROM sales_records UNION ALL SELECT 'all', 'all', refunds FROM sales_records) GROUP BY {KEYS}",
    "SELECT SUM(v) FROM (SELECT explode(array(gross_sales, refunds)) AS v FROM sales_records)", "SELECT sku, ROW_NUMBER() OVER (ORDER BY p) FROM (SELECT sku, gross_sales / units_sold AS p FROM sales_records)", "SELECT sku FROM sales_records GROUP BY sku HAVING SUM(gross_sales) > 5",
]


@pytest.fixture(scope="module")
def sales(spark):
    cols = "shop_id string, marketplace string, currency string, sku string, units_sold int, gross_sales decimal(18,2), refunds decimal(18,2), cogs decimal(18,2), operating_contribution decimal(18,2)"
    return spark.createDataFrame([], cols)


@pytest.mark.parametrize("sql", ACCEPTED)
def test_accepted(spark, sales, sql):
    assert scope.read_only_sql(spark, {"sales_records": sales}, "a", sql) is not None


@pytest.mark.parametrize("sql", REFUSED)
def test_refused(spark, sales, sql):
    with pytest.raises(scope.Refused, match="money"):
        scope.read_only_sql(spark, {"sales_records": sales}, "a", sql)


def test_frames_are_checked_too(sales):
    assert money.check_money(sales.groupBy("currency", "marketplace").sum("gross_sales")) is not None
    with pytest.raises(scope.Refused):
        money.check_money(sales.groupBy("currency").avg("refunds"))
