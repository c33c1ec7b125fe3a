"""Work of one task: by plans, as its memory follows from them."""

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import interim, investments, workflows
from ledgerline.plans import registry
from ledgerline.session import ROWS_A_TASK, dealt


def plan(frame):
    """As it is before it runs; a plan that has run is printed twice."""
    return frame.select("*")._jdf.queryExecution().executedPlan().toString()


def test_parts_grow_with_the_rows(spark):
    frame = spark.range(600).select((F.col("id") % 50).alias("k"))
    got = dealt(frame, 30 * ROWS_A_TASK, "k")
    assert got.rdd.getNumPartitions() == 30 and dealt(frame, 600, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert got.select("k", F.spark_partition_id().alias("p")).distinct().count() == 50


def test_columns_are_sorted_once(spark):
    """No label or value is sorted, and all that follows uses one order."""
    one = lambda v: [("c", 0, i, k, 1, "h", x, "u", True) for i, (k, x) in enumerate(v)]
    rows = one([("a", "100"), ("b", "50"), ("소계", "150"), ("소계", "0"), ("합계", "150")])  # the second subtotal has no members
    rows += [("d", *r[1:]) for r in one([("a", "100"), ("소계", "100"), ("b", "7"), ("소계", "7"), ("합계", "107")])]
    rows += [("e", *r[1:]) for r in one([("a", "5"), ("합계", "5"), ("b", "0")])]
    cells = spark.createDataFrame(rows, "chunk_id string, table_no int, row_no int, label string, column_no int, header string, value string, unit string, even boolean")
    found = investments.reconciled_totals(cells, 40 * ROWS_A_TASK)
    assert {r.chunk_id: r.state for r in found.collect()} == {"c": "subtotal_differs", "d": "ok", "e": "total_not_last"}
    assert plan(found).count("Sort [") == 1 and "REPARTITION_BY_NUM" in plan(found)


@pytest.mark.parametrize("rows", [1, 3 * ROWS_A_TASK])
def test_facts_and_ratios_share_one_deal(spark, rows):
    frame = spark.range(rows).select(
        F.col("id").alias("k"), F.lit("CFS").alias("fs_div"), F.lit("BS").alias("sj_div"), F.lit("KRW").alias("currency"), F.when(F.col("id") % 2 == 0, "부채총계").otherwise("자본총계").alias("account_nm"), F.lit("7").alias("thstrm_amount")
    )
    facts = workflows.facts(frame, ["k"])
    assert plan(facts).count("Exchange hashpartitioning") == 1 == plan(workflows.ratios(facts, ["k"])).count("Exchange hashpartitioning")
    assert facts.rdd.getNumPartitions() == max(spark.sparkContext.defaultParallelism, rows // ROWS_A_TASK)


def test_chunks_are_dealt_before_their_lines(spark):
    chunks = spark.createDataFrame([("a", "p", 1, "x\ny")], "doc_id string, path string, sequence int, text string")
    found = plan(interim.interim_figures(interim.statement_values(chunks)))
    assert found.count("Exchange") == 1 and found.index("Generate posexplode") < found.index("Exchange")  # plans are printed from their end


def test_an_amounts_digits_are_read_once(spark):
    from ledgerline.functions.numbers import accounting_text

    assert plan(spark.range(1).select(accounting_text(F.col("id").cast("string")).alias("x"))).count("[^0-9.]") == 1


def test_requests_are_never_broadcast(spark, sf):
    """Their number is that of the answers, which the plan's guess by compressed bytes doesn't show."""
    found = plan(registry.QUERIES["claims_grounded"](spark, sf))
    assert "Broadcast" not in found and found.count("SortMergeJoin") > 3
