"""Rules, quarantine, ledgers and scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality
from .derived import DIRTY_ORDERS_SQL, PRICES_SQL, dirty_orders  # noqa: F401
from .registry import query

D = f"WITH d AS ({DIRTY_ORDERS_SQL})"
RULES = {"status_known": "o_orderstatus IN ('F', 'O', 'P')", "amount_positive": "amount > 50000", "customer_known": "o_custkey < 10000000"}
FAILED = "(CASE WHEN coalesce(o_orderstatus IN ('F', 'O', 'P'), false) THEN '' ELSE 'status_known,' END || CASE WHEN coalesce(amount > 50000, false) THEN '' ELSE 'amount_positive,' END || CASE WHEN coalesce(o_custkey < 10000000, false) THEN '' ELSE 'customer_known,' END)"


@query("dq01_failures", f"{D} SELECT o_orderkey, rtrim({FAILED}, ',') AS failures FROM d")
def _(t):
    return quality.with_failures(dirty_orders(t), RULES).select("o_orderkey", F.array_join("dq_failures", ",").alias("failures"))


@query("dq02_split_valid", f"{D} SELECT CASE WHEN {FAILED} = '' THEN 'valid' ELSE 'quarantine' END AS part, count(*) AS n, CAST(sum(amount) AS DOUBLE) AS total FROM d GROUP BY 1")
def _(t):
    valid, bad = quality.split_valid(dirty_orders(t), RULES)
    one = lambda df, name: df.agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("n"), F.sum("amount").cast("double").alias("total"))
    return one(valid, "valid").unionByName(one(bad, "quarantine"))


@query("dq03_leaky_quarantine", f"{D} SELECT count(*) FILTER (o_orderstatus IN ('F', 'O') AND amount > 50000) AS valid, count(*) FILTER (NOT (o_orderstatus IN ('F', 'O') AND amount > 50000)) AS quarantined, count(*) AS n FROM d")
def _(t):
    """Rows with an unknown rule are in neither part."""
    rules = {"a": "o_orderstatus IN ('F', 'O')", "b": "amount > 50000"}
    return dirty_orders(t).agg(F.count_if(F.expr(quality.combined(rules))).alias("valid"), F.count_if(F.expr(quality.leaky_quarantine(rules))).alias("quarantined"), F.count(F.lit(1)).alias("n"))


@query("dq04_parenthesised_rules", f"{D} SELECT count(*) AS n FROM d WHERE (o_orderstatus = 'F' OR o_orderstatus = 'O') AND (amount > 50000)")
def _(t):
    return dirty_orders(t).where(quality.combined({"a": "o_orderstatus = 'F' OR o_orderstatus = 'O'", "b": "amount > 50000"})).agg(F.count(F.lit(1)).alias("n"))


@query("dq05_ambiguous_rules", "SELECT * FROM (VALUES ('status_known'), ('amount_positive')) AS v(rule)")
def _(t):
    rules = {"status_known": RULES["status_known"], "amount_positive": RULES["amount_positive"], "safe": "coalesce(amount > 0, false)"}
    return t.spark.createDataFrame([(r,) for r in quality.ambiguous_rules(dirty_orders(t), rules)], "rule string")


@query("dq06_missing_fields", f"{D} SELECT CASE WHEN o_orderstatus IS NULL AND amount IS NULL THEN 'o_orderstatus,amount' WHEN o_orderstatus IS NULL THEN 'o_orderstatus' WHEN amount IS NULL THEN 'amount' ELSE '' END AS missing, count(*) AS n FROM d GROUP BY 1")
def _(t):
    return quality.missing_fields(dirty_orders(t), ["o_orderstatus", "amount"]).groupBy(F.array_join("missing", ",").alias("missing")).agg(F.count(F.lit(1)).alias("n"))


@query("dq07_contract_diff", "SELECT * FROM (VALUES ('added', 'o_date'), ('missing', 'order_date')) AS v(kind, col)")
def _(t):
    diff = quality.contract_diff("o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, amount DECIMAL(18,2), o_orderpriority STRING, order_date DATE", dirty_orders(t))
    return t.spark.createDataFrame([(k, c) for k in ("added", "missing") for c in diff[k]], "kind string, col string")


@query("dq08_rate_gate", f"{D} SELECT round(count(*) FILTER (amount IS NULL)::DOUBLE / count(*), 6) AS rate FROM d")
def _(t):
    rate = quality.require_rate(dirty_orders(t), F.col("amount").isNull(), 0.10, "missing amounts")
    return t.spark.createDataFrame([(round(rate, 6),)], "rate double")


@query("dq09_ledger", f"""{D} SELECT 'all' AS step, count(*) AS n_rows, count(DISTINCT o_custkey) AS keys, count(amount) AS present, CAST(sum(amount) AS DOUBLE) AS total FROM d
  UNION ALL SELECT 'known', count(*), count(DISTINCT o_custkey), count(amount), CAST(sum(amount) AS DOUBLE) FROM d WHERE o_custkey < 10000000""")
def _(t):
    d = dirty_orders(t)
    both = quality.ledger(d, "all", "o_custkey", "amount").unionByName(quality.ledger(d.where("o_custkey < 10000000"), "known", "o_custkey", "amount"))
    return both.select("step", F.col("rows").alias("n_rows"), "keys", "present", F.col("total").cast("double").alias("total"))


@query("dq10_conservation", f"{D} SELECT count(*) AS parts_rows, count(*) AS whole_rows, CAST(sum(amount) AS DOUBLE) AS parts_sum, CAST(sum(amount) AS DOUBLE) AS whole_sum, true AS conserved FROM d")
def _(t):
    d = dirty_orders(t)
    out = quality.reconcile(quality.split_valid(d, RULES), d, "amount")
    return out.withColumns({"parts_sum": F.col("parts_sum").cast("double"), "whole_sum": F.col("whole_sum").cast("double")})


EXPECT = [quality.Expectation("status_known", RULES["status_known"], "warn"), quality.Expectation("amount_positive", RULES["amount_positive"], "drop"), quality.Expectation("keyed", "o_orderkey IS NOT NULL", "fail")]


@query("dq11_expectations", f"{D} SELECT o_orderkey FROM d WHERE coalesce(amount > 50000, false)")
def _(t):
    return quality.expect(dirty_orders(t), EXPECT)[0].select("o_orderkey")


@query("dq11_expectation_counts", f"{D} SELECT 'status_known' AS rule, count(*) AS failures FROM d WHERE o_orderstatus IS NULL UNION ALL SELECT 'amount_positive', count(*) FROM d WHERE NOT coalesce(amount > 50000, false)")
def _(t):
    return quality.expect(dirty_orders(t), EXPECT)[1]


@query("dq12_rules_as_rows", f"{D} SELECT count(*) AS n FROM d WHERE {FAILED} <> ''")
def _(t):
    rows = t.spark.createDataFrame([("orders", k, v, "high") for k, v in RULES.items()], "table_name string, rule_name string, constraint_sql string, severity string")
    return quality.split_valid(dirty_orders(t), quality.load_rules(rows, "orders"))[1].agg(F.count(F.lit(1)).alias("n"))


OUTCOMES_SQL = """
  WITH c AS (SELECT p_brand AS area, ['pass', 'partial', 'fail', 'unknown'][CAST(p_partkey % 4 AS INT) + 1] AS outcome, ['critical', 'high', 'medium', 'low', 'info'][CAST(p_partkey % 5 AS INT) + 1] AS severity FROM part),
       s AS (SELECT area, CASE outcome WHEN 'pass' THEN 1.0 WHEN 'partial' THEN 0.5 WHEN 'fail' THEN 0.0 END::DOUBLE AS credit, CASE severity WHEN 'critical' THEN 10.0 WHEN 'high' THEN 6.0 WHEN 'medium' THEN 3.0 WHEN 'low' THEN 1.0 ELSE 0.5 END::DOUBLE AS w FROM c)"""


@query("dq14_15_scores", f"""{OUTCOMES_SQL}, g AS (SELECT area, sum(w) AS w, coalesce(sum(w) FILTER (credit IS NOT NULL), 0) AS kw, coalesce(sum(w * credit), 0) AS e, count(*) FILTER (credit IS NULL) AS unmeasured FROM s GROUP BY 1),
  x AS (SELECT area, e / nullif(kw, 0) AS score, e / w AS low, (e + w - kw) / w AS high, unmeasured FROM g)
  SELECT area, round(score, 6) AS score, round(low, 6) AS low, round(high, 6) AS high, unmeasured,
         CASE WHEN score IS NULL OR (CASE WHEN low >= 0.8 THEN 'good' WHEN low >= 0.5 THEN 'fair' ELSE 'poor' END) <> (CASE WHEN high >= 0.8 THEN 'good' WHEN high >= 0.5 THEN 'fair' ELSE 'poor' END) THEN 'abstain'
              WHEN score >= 0.8 THEN 'good' WHEN score >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM x""")
def _(t):
    pick = lambda names, n: F.element_at(F.array(*(F.lit(x) for x in names)), (F.col("p_partkey") % n + 1).cast("int"))
    checks = t.part.select(F.col("p_brand").alias("area"), pick(["pass", "partial", "fail", "unknown"], 4).alias("outcome"), pick(["critical", "high", "medium", "low", "info"], 5).alias("severity"))
    return quality.score_outcomes(checks, ["area"]).withColumns({c: F.round(c, 6) for c in ("score", "low", "high")})
