"""What the physical plans must look like for the work to scale."""

import re

from conftest import SMALL

from twinframe.operators.ecdf import ks_test, pooled_ecdf, rank_statistics
from twinframe.operators.frequency import category_counts, category_shares
from twinframe.operators.moments import two_sample_moments
from twinframe.operators.neighbours import first_copies
from twinframe.operators.profile import numeric_text, profile
from twinframe.operators.ranges import with_row_index
from twinframe.plans.files import import_csv
from twinframe.plans.catalogue import LINEITEM_NUMBERS, lineitem_sides, order_sides, table
from twinframe.sources.scratch import cut_lineage


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def no_pairs(plan):
    return "NestedLoop" not in plan and "Cartesian" not in plan


def test_scans_read_only_needed_columns_and_push_filters(spark):
    plan = executed(two_sample_moments(*lineitem_sides(spark, SMALL), ["l_quantity"]))
    schemas = set(re.findall(r"ReadSchema: struct<(.*?)>", plan))
    assert schemas == {"l_quantity:double,l_returnflag:string"}
    assert "EqualTo(l_returnflag,R)" in plan


def test_running_counts_start_from_distinct_values_read_once(spark, monkeypatch):
    monkeypatch.setattr("twinframe.operators.ecdf.cut_lineage", lambda df: df)
    plan = executed(ks_test(rank_statistics(pooled_ecdf(*lineitem_sides(spark, SMALL), LINEITEM_NUMBERS))))
    assert no_pairs(plan) and "partial_count" in plan  # equal values collapse before the shuffle


def test_ranges_hold_even_shares_of_distinct_values(spark, monkeypatch):
    kept = []
    monkeypatch.setattr("twinframe.operators.ecdf.cut_lineage", lambda df: kept.append(cut_lineage(df)) or kept[-1])
    skewed = spark.range(20000).selectExpr("if(id % 20 = 0, cast(id as double), 0.0) AS x")
    pooled_ecdf(skewed, skewed, ["x"], rows_per_range=100).collect()
    sizes = [r["count"] for r in kept[-1].groupBy("_range").count().collect()]
    assert len(sizes) >= 8 and max(sizes) <= 200


def test_an_import_scans_the_text_at_most_three_times(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b\n" + "".join(f"{n},w{n}\n" for n in range(100)))
    before = scans(spark, str(path))
    import_csv(spark, str(path))
    assert len(scans(spark, str(path))) - len(before) <= 3


def test_the_probe_reads_the_start_of_the_table(spark, monkeypatch):
    monkeypatch.setattr("twinframe.operators.profile.PROBE_ROWS", 64)
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsList().size()
    cells = table(spark, SMALL, "documents").selectExpr("doc_id AS _at", "text", "CAST(n_chars AS string) AS n")
    assert numeric_text(cells, ["text", "n"]) == {"text": False, "n": True}
    plans = [store.executionsList().apply(at).physicalPlanDescription() for at in range(before, store.executionsList().size())]
    probes = [p for p in plans if re.search(r"ReadSchema: struct<[^>]*(text|n_chars)", p)]
    assert probes and all("LessThan(doc_id," in p for p in probes)


def scans(spark, path):
    """The executed plans that read a text file whole."""
    store = spark._jsparkSession.sharedState().statusStore()
    plans = [store.executionsList().apply(at).physicalPlanDescription() for at in range(store.executionsList().size())]
    return [p for p in plans if f"{path}]" in p and "InMemoryFileIndex" in p and "Limit" not in p]


def test_category_totals_share_the_shuffled_counts(spark):
    plan = executed(category_shares(category_counts(*order_sides(spark, SMALL), ["o_orderstatus"])))
    assert "ReusedExchange" in plan and no_pairs(plan)


def test_copies_are_limited_before_the_shuffle(spark):
    rows = spark.createDataFrame([(0, [1.0], ["a"])], "row_idx bigint, z array<double>, cats array<string>")
    plan = executed(first_copies(rows, 5))
    assert re.search(r"WindowGroupLimit.*Partial", plan)


def test_row_index_windows_are_partitioned(spark, monkeypatch):
    monkeypatch.setattr("twinframe.operators.ranges.cut_lineage", lambda df: df)
    orders = table(spark, SMALL, "orders").select("o_orderkey", "o_orderdate")
    plan = executed(with_row_index(orders, ["o_orderkey"], 300))
    assert "rangepartitioning" in plan and "SinglePartition" not in plan.split("Window")[0] and no_pairs(plan)


def test_profile_shuffles_narrow_cells(spark):
    plan = executed(profile(table(spark, SMALL, "orders")))
    assert "Expand" not in plan and no_pairs(plan)
    assert set(re.findall(r"Exchange hashpartitioning\((\w+)#\d+, value", plan)) == {"ordinal"}
