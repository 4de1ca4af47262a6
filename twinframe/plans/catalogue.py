"""The registered queries: each reads the given tables whole and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from twinframe.functions.cells import canonical_text, clean_text
from twinframe.functions.rng import uniform, vote_choice, weighted_choice
from twinframe.operators.ecdf import average_rank, ks_test, mann_whitney, pooled_ecdf, rank_statistics
from twinframe.operators.frequency import (
    category_counts,
    category_shares,
    category_tests,
    chi_square_test,
    total_variation,
)
from twinframe.operators.histogram import two_sample_histogram
from twinframe.operators.moments import describe, synthesis_stats, t_test, two_sample_moments
from twinframe.operators.neighbours import classes_of, neighbour_votes
from twinframe.operators.profile import apply_types, badge, collect_profile, profile, profile_text
from twinframe.operators.ranges import with_row_index
from twinframe.plans.report import FidelityReport, fidelity_report
from twinframe.plans.synthesize import (
    bootstrap_rows,
    indexed_features,
    synthesize,
    synthetic_numbers,
    table_facts,
    with_neighbours,
)
from twinframe.sources.csv import ROW_INDEX, clean_cells, read_csv, write_csv, write_text
from twinframe.sources.scratch import cut_lineage, new_folder

SEED = 7
LINEITEM_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount"]
LINEITEM_COLUMNS = ["l_linenumber", *LINEITEM_NUMBERS, "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]
LINEITEM_KEY = [
    "l_orderkey",
    "l_linenumber",
    "l_partkey",
    "l_suppkey",
    "l_quantity",
    "l_extendedprice",
    "l_discount",
    "l_tax",
    "l_returnflag",
    "l_linestatus",
    "l_shipdate",
]
ORDER_CATEGORIES = ["o_orderstatus", "o_orderpriority"]
CUSTOMER_COLUMNS = ["c_nationkey", "c_acctbal", "c_mktsegment"]
PART_COLUMNS = ["p_brand", "p_type", "p_size", "p_retailprice", "p_name"]
SUPPLIER_COLUMNS = ["s_nationkey", "s_acctbal"]
LINEITEM_SYNTH = ["l_linenumber", *LINEITEM_NUMBERS, "l_tax", "l_returnflag", "l_linestatus"]
TARGET_SIZE = 1000  # the default number of synthetic rows


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles at comparable precision; adding 0.0 turns -0.0 into 0.0."""
    return df.select(
        *[
            (F.round(F.col(f.name), places) + 0.0).alias(f.name) if isinstance(f.dataType, T.DoubleType) else f.name
            for f in df.schema
        ]
    )


def lineitem_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, folder, "lineitem")
    return lines.where(F.col("l_returnflag") == "R"), lines.where(F.col("l_returnflag") == "A")


def order_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    orders = table(spark, folder, "orders")
    day = F.col("o_orderdate")

    def year(number: int) -> DataFrame:
        return orders.where((day >= F.lit(f"{number}-01-01").cast("timestamp")) & (day < F.lit(f"{number + 1}-01-01").cast("timestamp")))

    return year(1995), year(1996)


def event_sides(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    events = table(spark, folder, "events")
    middle = F.lit("2024-01-16").cast("timestamp")
    return events.where(F.col("ts") < middle), events.where(F.col("ts") >= middle)


def customers_with_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with missing cells put in, since the tables have none."""
    key = F.col("c_custkey")
    return table(spark, folder, "customer").select(
        "c_custkey",
        "c_nationkey",
        F.when(key % 7 != 0, F.col("c_acctbal")).alias("c_acctbal"),
        F.when(key % 5 != 0, F.col("c_mktsegment")).alias("c_mktsegment"),
        F.when(key % 11 != 0, F.substring("c_name", -1, 1)).alias("c_digit"),
    )


# profiles, cleaning, ingest


def profile_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return badge(profile(table(spark, folder, "lineitem"))).drop("ordinal")


def profile_customer_gaps(spark: SparkSession, folder: str) -> DataFrame:
    return profile(customers_with_gaps(spark, folder)).drop("ordinal")


def numeric_probe_documents(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    cells = docs.select("doc_id", *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source", "n_chars")])
    return profile_text(cells, "doc_id").drop("ordinal")


def numeric_probe_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events as text; ``mixed`` turns into words after the first 50 values of the table."""
    events = table(spark, folder, "events")
    mixed = F.when(F.col("event_id") < 60, F.col("user_id").cast("string")).otherwise(F.col("event_type"))
    cells = events.select(
        "event_id",
        *[F.col(c).cast("string").alias(c) for c in ("user_id", "event_type", "value", "props")],
        mixed.alias("mixed"),
    )
    return profile_text(cells, "event_id").drop("ordinal")


def clean_missing_tokens(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders")
    tokens = ["null", " NaN ", "N/A", "Continuous", "undefined", "none", ""]
    cell = F.col("o_orderpriority")
    for at, token in enumerate(tokens):
        cell = F.when(F.col("o_orderkey") % 11 == at, F.lit(token)).otherwise(cell)
    return clean_cells(orders.select("o_orderkey", cell.alias("cell")))


def clean_timestamps(spark: SparkSession, folder: str) -> DataFrame:
    """Event times spelled in four ways, as the categories that they stand for; the fourth lacks its offset and stays text."""
    at, seconds = F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss"
    # by the remainder of the id: whole seconds, another offset, more digits than milliseconds, no offset
    spelled = (
        F.when(F.col("event_id") % 4 == 0, F.concat(F.date_format(at, seconds), F.lit("Z")))
        .when(F.col("event_id") % 4 == 1, F.concat(F.date_format(at + F.expr("INTERVAL '5:30' HOUR TO MINUTE"), seconds), F.lit("+05:30")))
        .when(F.col("event_id") % 4 == 2, F.concat(F.date_format(at, seconds), F.lit(".0000Z")))
        .otherwise(F.date_format(at, seconds))
    )
    return table(spark, folder, "events").select("event_id", canonical_text(clean_text(spelled)).alias("stamp"))


def csv_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Customers through the CSV sink and the loose CSV source, typed by their profile."""
    path = new_folder(spark, "customer.csv")
    write_csv(table(spark, folder, "customer").orderBy("c_custkey"), path)
    raw = read_csv(spark, path)
    typed = apply_types(raw, collect_profile(profile_text(raw, ROW_INDEX)))
    return typed


def row_index_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders = table(spark, folder, "orders").select("o_orderdate", "o_orderkey")
    return with_row_index(orders, ["o_orderdate", "o_orderkey"], rows_per_range=2000).select("o_orderkey", ROW_INDEX)


def row_index_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Customers with missing cells, all columns as key over many ranges; NULL comes first."""
    columns = ["c_mktsegment", "c_acctbal", "c_digit", "c_nationkey", "c_custkey"]
    rows = customers_with_gaps(spark, folder).select(*columns)
    return with_row_index(rows, columns, rows_per_range=100).select("c_custkey", ROW_INDEX)


def csv_roundtrip_text(spark: SparkSession, folder: str) -> DataFrame:
    """Conversations with quotes, separators and line breaks in their cells, out and in again."""
    path = new_folder(spark, "conversations.csv")
    text = F.concat("text", F.lit(' "quoted", and\nbelow '), "role")
    write_csv(table(spark, folder, "conversations").select("conv_id", "turn", "role", text.alias("text")), path)
    return read_csv(spark, path).drop(ROW_INDEX)


# two-sample comparisons


def synthesis_stats_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(synthesis_stats(table(spark, folder, "lineitem"), LINEITEM_NUMBERS))


def describe_two_sample(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(describe(two_sample_moments(*lineitem_sides(spark, folder), LINEITEM_NUMBERS)))


def t_test_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(t_test(two_sample_moments(*lineitem_sides(spark, folder), LINEITEM_NUMBERS)))


def ecdf_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return pooled_ecdf(*lineitem_sides(spark, folder), LINEITEM_NUMBERS)


def average_ranks_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    ranked = ecdf_lineitem(spark, folder).withColumn("rank", average_rank())
    return ranked.select("column", "value", "rank", (F.col("c1") + F.col("c2")).alias("ties"))


def mann_whitney_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(mann_whitney(rank_statistics(ecdf_lineitem(spark, folder))))


def ks_test_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(ks_test(rank_statistics(ecdf_lineitem(spark, folder))))


def ks_test_skewed(spark: SparkSession, folder: str) -> DataFrame:
    """One value holds nearly all rows of a column; ranges are cut by distinct values."""
    price = F.when(F.col("l_orderkey") % 200 == 0, F.col("l_extendedprice")).otherwise(0.0)
    sides = [side.withColumn("l_extendedprice", price) for side in lineitem_sides(spark, folder)]
    return rounded(ks_test(rank_statistics(pooled_ecdf(*sides, LINEITEM_NUMBERS, rows_per_range=50))))


def category_freq(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(category_shares(category_counts(*order_sides(spark, folder), ORDER_CATEGORIES)))


def chi_square_cramers_v(spark: SparkSession, folder: str) -> DataFrame:
    shares = category_shares(category_counts(*order_sides(spark, folder), ORDER_CATEGORIES))
    return rounded(chi_square_test(category_tests(shares)))


def tvd_events(spark: SparkSession, folder: str) -> DataFrame:
    shares = category_shares(category_counts(*event_sides(spark, folder), ["event_type", "user_id"]))
    return rounded(total_variation(category_tests(shares)))


def histogram_two_sample(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(two_sample_histogram(*lineitem_sides(spark, folder), LINEITEM_NUMBERS))


# synthesis


def zscore_features(spark: SparkSession, folder: str) -> DataFrame:
    customers = customers_with_gaps(spark, folder)
    facts = table_facts(customers, CUSTOMER_COLUMNS)
    features = indexed_features(customers, facts, ["c_custkey"])
    z = [F.col("z")[at].alias(f"z_{c}") for at, c in enumerate(facts.numeric)]
    return rounded(features.select(ROW_INDEX, *z, "c_mktsegment"))


def bootstrap_customers(spark: SparkSession, folder: str) -> DataFrame:
    indexed = with_row_index(table(spark, folder, "customer"), ["c_custkey"])
    rows = indexed.count()
    return bootstrap_rows(indexed, rows, rows, SEED).select("i", ROW_INDEX, "c_custkey", "c_acctbal")


def _numeric_synthesis(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    facts = table_facts(df, columns)
    features = indexed_features(df, facts, [key])
    made = synthetic_numbers(bootstrap_rows(features, facts.rows, facts.rows, SEED), facts, SEED)
    return rounded(made.select("i", ROW_INDEX, *facts.numeric))


def numeric_synthesis_customer(spark: SparkSession, folder: str) -> DataFrame:
    return _numeric_synthesis(customers_with_gaps(spark, folder), "c_custkey", ["c_nationkey", "c_acctbal"])


def numeric_synthesis_part(spark: SparkSession, folder: str) -> DataFrame:
    return _numeric_synthesis(table(spark, folder, "part"), "p_partkey", ["p_size", "p_retailprice"])


def _part_neighbours(spark: SparkSession, folder: str) -> tuple[DataFrame, list[str]]:
    parts = table(spark, folder, "part")
    facts = table_facts(parts, PART_COLUMNS)
    return with_neighbours(parts, facts, facts.rows, SEED, ["p_partkey"]), facts.categorical


def knn_top5(spark: SparkSession, folder: str) -> DataFrame:
    found, names = _part_neighbours(spark, folder)
    entries = found.select("i", F.inline("neighbours"))
    target = F.get(F.array(*[F.lit(n) for n in names]), "target")
    return rounded(entries.select("i", target.alias("target"), "rank", ROW_INDEX, "distance", "class"))


def knn_votes(spark: SparkSession, folder: str) -> DataFrame:
    return neighbour_votes(*_part_neighbours(spark, folder))


def knn_vote_choice(spark: SparkSession, folder: str) -> DataFrame:
    found, names = _part_neighbours(spark, folder)
    picks = [vote_choice(classes_of(t), uniform(SEED, F.col("i"), f"{c}:pick")).alias(c) for t, c in enumerate(names)]
    return found.select("i", *picks)


def knn_weighted_choice(spark: SparkSession, folder: str) -> DataFrame:
    """The choice from (class, votes) pairs, at most five per synthetic row and target."""
    found, names = _part_neighbours(spark, folder)
    ordered = F.sort_array(F.collect_list(F.struct("first_rank", F.col("class").alias("value"), F.col("votes").alias("weight"))))
    options = neighbour_votes(found, names).groupBy("i", "target").agg(ordered.alias("options"))
    draw = F.coalesce(*[F.when(F.col("target") == n, uniform(SEED, F.col("i"), f"{n}:pick")) for n in names])
    return options.select("i", "target", weighted_choice(F.col("options"), draw).alias("class"))


def lone_category_copy(spark: SparkSession, folder: str) -> DataFrame:
    """Nation names alone: nothing to measure distance by, so seed values are copied."""
    nations = table(spark, folder, "nation")
    return synthesize(nations, nations.count(), SEED, ["n_nationkey"], ["n_name"], keep_row=True)


def synthesize_supplier(spark: SparkSession, folder: str) -> DataFrame:
    suppliers = table(spark, folder, "supplier")
    return synthesize(suppliers, suppliers.count(), SEED, ["s_suppkey"], SUPPLIER_COLUMNS, keep_row=True)


def synthesize_customer(spark: SparkSession, folder: str) -> DataFrame:
    customers = table(spark, folder, "customer")
    return synthesize(customers, customers.count(), SEED, ["c_custkey"], CUSTOMER_COLUMNS, keep_row=True)


def synthesize_customer_gaps(spark: SparkSession, folder: str) -> DataFrame:
    customers = customers_with_gaps(spark, folder)
    columns = [*CUSTOMER_COLUMNS, "c_digit"]
    return synthesize(customers, customers.count(), SEED, ["c_custkey"], columns, keep_row=True)


def synthesize_part(spark: SparkSession, folder: str) -> DataFrame:
    parts = table(spark, folder, "part")
    return synthesize(parts, parts.count(), SEED, ["p_partkey"], PART_COLUMNS, keep_row=True)


def synthesize_part_blocked(spark: SparkSession, folder: str) -> DataFrame:
    """The same rows by the blocked search that tables beyond the broadcast limit use."""
    parts = table(spark, folder, "part")
    return synthesize(
        parts,
        parts.count(),
        SEED,
        ["p_partkey"],
        PART_COLUMNS,
        keep_row=True,
        strategy="blocked",
        rows_per_block=256,
        queries_per_block=512,
    )


def synthesize_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    """The default number of rows from the whole of the largest table, by the blocked search."""
    lines = table(spark, folder, "lineitem")
    return synthesize(lines, TARGET_SIZE, SEED, LINEITEM_KEY, LINEITEM_SYNTH, keep_row=True, strategy="blocked")


def synthesize_clashing_names(spark: SparkSession, folder: str) -> DataFrame:
    """Parts whose columns bear the names that the library uses for its own."""
    names = dict(zip(PART_COLUMNS, ["z", "cats", "key", "is_orig", "neighbours"])) | {"p_partkey": "_range"}
    parts = table(spark, folder, "part").select(*[F.col(c).alias(n) for c, n in names.items()])
    columns = [names[c] for c in PART_COLUMNS]
    return synthesize(parts, parts.count(), SEED, ["_range"], columns, strategy="blocked", rows_per_block=256)


# reports


def _lineitem_report(spark: SparkSession, folder: str) -> FidelityReport:
    return fidelity_report(*lineitem_sides(spark, folder), LINEITEM_COLUMNS)


def stats_summary_lineitem(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_lineitem_report(spark, folder).stats_summary()).drop("ordinal")


def stats_summary_orders(spark: SparkSession, folder: str) -> DataFrame:
    report = fidelity_report(*order_sides(spark, folder), ["o_totalprice", *ORDER_CATEGORIES])
    return rounded(report.stats_summary()).drop("ordinal")


def stats_summary_csv(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem_report(spark, folder).stats_summary_text().drop("ordinal")


def stats_summary_missing_column(spark: SparkSession, folder: str) -> DataFrame:
    """The synthetic side lacks two columns: they count as missing there."""
    orig, synth = lineitem_sides(spark, folder)
    report = fidelity_report(orig, synth.drop("l_returnflag", "l_linestatus"), LINEITEM_COLUMNS)
    return rounded(report.stats_summary()).drop("ordinal")


def histograms_report(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_lineitem_report(spark, folder).histograms())


def text_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The text report written and read back."""
    path = new_folder(spark, "report.txt")
    write_text(_lineitem_report(spark, folder).text(), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


def summary_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The summary written as CSV and read back as text."""
    path = new_folder(spark, "stats_summary.csv")
    write_csv(_lineitem_report(spark, folder).stats_summary_text().orderBy("ordinal").coalesce(1).drop("ordinal"), path)
    return read_csv(spark, path).drop(ROW_INDEX)


def test_results(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_lineitem_report(spark, folder).tests())


def test_tables(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem_report(spark, folder).test_table()


def categorical_table(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_lineitem_report(spark, folder).categorical_table())


def descriptive_table(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem_report(spark, folder).descriptive_table().drop("ordinal")


def report_summary(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(_lineitem_report(spark, folder).summary())


def text_report(spark: SparkSession, folder: str) -> DataFrame:
    return _lineitem_report(spark, folder).text()


def synthesis_fidelity(spark: SparkSession, folder: str) -> DataFrame:
    """End to end: synthesize customers, then report how faithful the copy is."""
    customers = table(spark, folder, "customer")
    made = cut_lineage(synthesize(customers, customers.count(), SEED, ["c_custkey"], CUSTOMER_COLUMNS))
    return rounded(fidelity_report(customers, made, CUSTOMER_COLUMNS).stats_summary()).drop("ordinal")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    query.__name__: query
    for query in (
        profile_lineitem,
        profile_customer_gaps,
        numeric_probe_documents,
        numeric_probe_events,
        clean_missing_tokens,
        clean_timestamps,
        csv_roundtrip,
        csv_roundtrip_text,
        row_index_orders,
        row_index_gaps,
        synthesis_stats_lineitem,
        describe_two_sample,
        t_test_lineitem,
        ecdf_lineitem,
        average_ranks_lineitem,
        mann_whitney_lineitem,
        ks_test_lineitem,
        ks_test_skewed,
        category_freq,
        chi_square_cramers_v,
        tvd_events,
        histogram_two_sample,
        zscore_features,
        bootstrap_customers,
        numeric_synthesis_customer,
        numeric_synthesis_part,
        knn_top5,
        knn_votes,
        knn_vote_choice,
        knn_weighted_choice,
        lone_category_copy,
        synthesize_supplier,
        synthesize_customer,
        synthesize_customer_gaps,
        synthesize_part,
        synthesize_part_blocked,
        synthesize_lineitem,
        synthesize_clashing_names,
        stats_summary_lineitem,
        stats_summary_orders,
        stats_summary_csv,
        stats_summary_missing_column,
        test_results,
        test_tables,
        categorical_table,
        descriptive_table,
        report_summary,
        text_report,
        text_sink,
        summary_sink,
        histograms_report,
        synthesis_fidelity,
    )
}
