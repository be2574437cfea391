import pytest

from millrace.operators import scope


@pytest.fixture(scope="module")
def sales(spark):
    return spark.createDataFrame([("a", "s1", 5), ("a", "s2", 7), ("b", "s1", 100)], "shop_id string, sku string, units int")


@pytest.mark.parametrize("sql", [
    "SELECT * FROM sales_records",
    "SELECT s.* FROM sales_records s JOIN sales_records t ON s.sku = t.sku",
    "WITH x AS (SELECT * FROM sales_records) SELECT * FROM x",
    "SELECT * FROM sales_records WHERE shop_id = 'a' OR 1 = 1",
    "SELECT * FROM sales_records UNION ALL SELECT * FROM sales_records WHERE shop_id = 'b'",
    "select * from sales_records) q cross join (select 1 from sales_records",
    "WITH base AS (SELECT * FROM sales_records), ranked AS (SELECT shop_id FROM base) SELECT * FROM ranked",
    "SELECT * FROM sales_records WHERE sku IN (SELECT sku FROM SALES_RECORDS)",
    "SELECT s.* FROM sales_records s, (VALUES (1)) AS v",
])
def test_only_own_shop(spark, sales, sql):
    rows = scope.read_only_sql(spark, {"sales_records": sales}, "a", sql).collect()
    assert rows and all(r["shop_id"] == "a" for r in rows if "shop_id" in r.asDict())


@pytest.mark.parametrize("sql", [
    "DROP TABLE sales_records", "INSERT INTO sales_records VALUES (1)", "SET x = 1 -- sales_records", "SELECT 1; SELECT * FROM sales_records", "SELECT java_method('java.lang.System', 'exit', 0) FROM sales_records",
    "SELECT * FROM parquet.`/tmp/x` JOIN sales_records", "SELECT 1", "DELETE FROM sales_records", "SELECT * FROM sales_records -- bypass", "SELECT * FROM information_schema.tables", "UPDATE sales_records SET units = 0",
    "INSERT INTO sales_records(shop_id) VALUES ('x')", "CREATE TABLE copied AS SELECT * FROM sales_records", "ALTER TABLE sales_records ADD COLUMN note STRING", "TRUNCATE TABLE sales_records", "EXPLAIN DELETE FROM sales_records",
    "SELECT * FROM sales_records; /* harmless */ DROP TABLE users", "DR/**/OP TABLE users", "SELECT * FROM users", "SELECT * FROM sales_records JOIN users ON users.id = sales_records.id",
    "SELECT o.* FROM other_view o, sales_records", "SELECT sku, 'sales_records' AS t FROM other_view", "SELECT * FROM sales_records WHERE sku IN (SELECT sku FROM other_view)", "SELECT (SELECT max(units) FROM other_view) FROM sales_records",
    "SELECT * FROM (WITH other_view AS (SELECT * FROM sales_records) SELECT * FROM other_view) a, other_view", "SELECT * FROM other_view JOIN (SELECT * FROM sales_records) other_view", "SELECT * FROM default.sales_records", "SELECT * FROM range(3), sales_records", "SELECT * FROM {other}, sales_records", "",
])
def test_refused(spark, sales, sql):
    sales.createOrReplaceTempView("other_view")
    with pytest.raises(scope.Refused):
        scope.read_only_sql(spark, {"sales_records": sales}, "a", sql).collect()


def test_row_cap(spark, sales):
    assert scope.row_cap(sales, None, 2).count() == 2
    assert scope.row_cap(sales, 1, 2).count() == 1
    with pytest.raises(scope.Refused):
        scope.read_only_sql(spark, {"sales_records": sales}, "a", "SELECT * FROM sales_records", 0)
