"""Catalog answers against a look at all pairs."""

import random

from millrace.operators import support

REQUESTS = "request_id long, shop_id string, category string, max_price decimal(12,2), power_w int, in_stock_only boolean"
PRODUCTS = "id long, shop_id string, sku string, name string, category string, price decimal(12,2), stock int, specifications string, is_active boolean"


def fits(q, p):
    _, shop, category, price, power, stocked = q
    _, p_shop, _, _, p_category, p_price, stock, watts, active = p
    ok = active and shop is not None and shop == p_shop and (category is None or (p_category is not None and category.lower() == p_category.lower()))
    ok = ok and (price is None or (p_price is not None and p_price <= price)) and (power is None or power == watts)
    return ok and (stocked is False or (stock is not None and stock > 0))


def test_catalog_answers_equal_all_pairs(spark):
    r = random.Random(5)
    products = [(i, r.choice(["1", "2", None]), f"S{i}", f"n{i}", r.choice(["Cable", "bank", None]), r.choice([None, 5, 7, 9, 12]), r.choice([None, 0, 3]), r.choice([None, 10, 20]), r.random() < 0.9) for i in range(300)]
    requests = [(i, r.choice(["1", "2", "3", None]), r.choice([None, "cable", "BANK"]), r.choice([None, 4, 7, 20]), r.choice([None, 10, 30]), r.choice([True, False, None])) for i in range(600)]
    from decimal import Decimal

    money = lambda x: None if x is None else Decimal(x)
    spec = lambda w: "{}" if w is None else '{"power_w": %d}' % w
    q = spark.createDataFrame([(*x[:3], money(x[3]), *x[4:]) for x in requests], REQUESTS)
    p = spark.createDataFrame([(*x[:5], money(x[5]), x[6], spec(x[7]), x[8]) for x in products], PRODUCTS)
    got = sorted((x.request_id, x.position, x.id) for x in support.catalog_answer_join(q, p, 3).collect())
    want = []
    for x in requests:
        found = sorted((y for y in products if fits(x, y)), key=lambda y: (y[5] is not None, y[5] or 0, y[0]))[:3]
        want += [(x[0], n + 1, y[0]) for n, y in enumerate(found)]
    assert got == sorted(want) and len(want) > 200


def test_requests_meet_the_cheapest_products_alone(spark):
    """every request met every fitting product of its shop before the cheapest were taken."""
    from decimal import Decimal

    q = spark.createDataFrame([(i, "1", None, Decimal(100), None, True) for i in range(50)], REQUESTS)
    p = spark.createDataFrame([(i, "1", f"S{i}", "n", "c", Decimal(i), 1, "{}", True) for i in range(1000)], PRODUCTS)
    plan = support.catalog_answer_join(q, p)._jdf.queryExecution().optimizedPlan().toString().splitlines()
    join = next(i for i, x in enumerate(plan) if "Join Inner" in x)
    assert any("Window [row_number()" in x for x in plan[join:])
    assert support.catalog_answer_join(q, p).count() == 250
