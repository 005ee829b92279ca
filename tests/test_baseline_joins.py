"""The comparison with a base never broadcasts tables that grow with the functions, however small the optimizer takes them for."""

from brickyard.plans import baseline


def test_functions_and_violations_are_not_broadcast(spark):
    columns = ["'function-complexity' AS metric", "'function' AS kind", "'max' AS direction", "string(id) AS subject", "double(id) AS value", "'m' AS message", "false AS historical"]
    rows = spark.range(50).selectExpr("concat('b', id % 5) AS brick", *columns)
    functions = spark.range(50).selectExpr("concat('b', id % 5) AS brick", "string(id) AS id", "1 AS complexity", "1 AS depth", "1 AS forms", "1 AS params")
    values = rows.select("brick", "metric", "value").filter("brick = 'none'")
    found = baseline.compare(rows, rows, rows.select("brick"), values, functions)
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("SortMergeJoin") >= 3  # functions, the known ones among the violations, and these
    assert found.count() == 50
