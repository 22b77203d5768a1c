from ledgerline.plans import economics
from ledgerline.session import TASK_BYTES, tune


def test_products_are_counted_without_a_row_for_each_order(spark):
    """An order's list is unfolded and counted by product at once; pairs of order and product are no groups."""
    schema = "user_id long, order_id long, action string, time timestamp"
    actions = spark.createDataFrame([(1, 3, "cancel_order", None)], schema)
    orders = spark.createDataFrame([(1,), (2,), (3,)], "order_id long")
    baskets = spark.createDataFrame([(1, [7, 7, 8]), (2, [7]), (3, [8]), (4, [8]), (2, None)], "order_id long, product_ids array<long>")
    products = spark.createDataFrame([(7, "a", 2.0), (8, "b", 4.0)], "product_id long, name string, price double")
    got = economics.product_share(actions, orders, economics.basket_lines(baskets), products)
    assert {(r.product_name, r.revenue, r.share_in_revenue) for r in got.collect()} == {("a", 6.0, 60.0), ("b", 4.0, 40.0)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    groups = [line for line in plan.splitlines() if "Aggregate [order_id" in line]
    assert groups and not any("product_id" in line for line in groups)


def test_tasks_read_little_unless_the_user_says_so(spark):
    key, small = TASK_BYTES
    was = spark.conf.get(key, None)
    try:
        spark.conf.unset(key)
        tune(spark)
        assert spark.conf.get(key) == small == "8m"
        spark.conf.set(key, "3m")
        tune(spark)
        assert spark.conf.get(key) == "3m"
    finally:
        spark.conf.unset(key) if was is None else spark.conf.set(key, was)
