"""Registered queries: the reference's analytical questions, re-posed on the driver tables.

Each function takes ``(spark, sf_dir)``, reads whole tables (only the columns
it needs, so the parquet scan is pruned) and returns a lazy DataFrame built
from the library operators: no Spark job runs while it is built.  Where the
reference stores numbers as text, the query first renders the needed columns
as text with the dirt the dumps contain (NULL, blanks, junk, thousands commas,
stray marks, impossible hours), by a rule on the key; that only shapes the
input, the cleaning itself is the operator's work.  Output columns are aliased to the names the oracle SQL
uses; computed integers are BIGINT and computed measures DOUBLE (columns
passed through keep their stored types), so the two sides carry the same
schema.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clean import (coalesce_existing, id_from_prefixed, onehot_label, parse_dmy, parse_hour, split_pair,
                               to_number)
from ..functions.numeric import (fixed_mean, fixed_sum, floor_half_up, format_fixed, to_units, unit_sum, units_mean,
                                 units_to_fixed)
from ..functions.predicates import contains_text, exclude_both, matches, ordinal_position
from ..functions import collate, lists
from ..operators import agg, join, nested, panel, rank, score, shape, sketch, stats
from ..operators.facets import facets
from ..operators.gram import corr_tiles
from ..operators.ranges import range_lookup
from ..operators.score import ScenarioSpec
from ..session import ensure_checkpoint_dir
from ..sources import export
from ..sources.tables import load

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values chosen for the analogues (thresholds, cohorts, word lists).
SOUTHERN_REGIONS = ["AFRICA"]
PRICE_TIERS = (226000.0, 275000.0)
COHORT_A = ["brand#1", "brand#2", "brand#3", "brand#4", "brand#5"]
COHORT_B = ["brand#20", "brand#21", "brand#22", "brand#23", "brand#24"]
EXCLUDED_WORDS = ["bolt", "ring", "rod", "Plate", "screw"]
EXCLUDED_PATTERN = "bolt|ring|rod|Plate|screw"
PRIORITY_ORDER = ["urgent", "high", "routine"]
# The classes of the rule query, most urgent first.
ACTION_LABELS = ("act now", "review", "watch")


def _double(c: str) -> F.Column:
    return F.col(c).cast("double")


def _repeated(c: str, times: str) -> tuple[F.Column, F.Column]:
    """Fixed-point units and count of a value that stands for ``times`` joined rows."""
    units = to_units(c).cast("decimal(19,0)") * F.col(times).cast("decimal(18,0)")
    return units, F.when(F.col(c).isNotNull(), F.col(times))


# --- Q1: first -> last period change -------------------------------------------------
def q_first_last_delta(spark: SparkSession, sf: str) -> DataFrame:
    """Q1: each customer's order value at its first and last order date and the change (half-up)."""
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"])
    out = panel.first_last_delta(orders, "o_custkey", "o_orderdate", "o_totalprice", tiebreak="o_orderkey")
    return out.orderBy(F.col("delta").desc(), "o_custkey")


def q_first_last_delta_half_even(spark: SparkSession, sf: str) -> DataFrame:
    """The document-store form: only the change, rounded half-even (``$round``)."""
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"])
    out = panel.first_last_delta(orders, "o_custkey", "o_orderdate", "o_totalprice", tiebreak="o_orderkey",
                                 rounding="half_even")
    return out.select("o_custkey", "delta").orderBy(F.col("delta").desc(), "o_custkey")


# --- Q2: mean over the latest n periods ----------------------------------------------
def _customer_years(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    return orders.groupBy("o_custkey", F.year("o_orderdate").cast("bigint").alias("o_year")).agg(
        fixed_sum("o_totalprice").alias("total_price"),
        F.count(F.lit(1)).alias("n_orders"))


def _last_n(spark: SparkSession, sf: str, by: str) -> DataFrame:
    # One row per (customer, year) after the first aggregate: groups are bounded by the number of years.
    out = panel.last_n_periods_avg(_customer_years(spark, sf), "o_custkey", "o_year",
                                   ["total_price", "n_orders"], n=3, by=by, bounded_groups=True)
    return out.select("o_custkey", F.col("n_periods").cast("bigint"),
                      _double("avg_total_price").alias("avg_total_price"),
                      _double("avg_n_orders").alias("avg_n_orders")).orderBy("o_custkey")


def q_last_n_periods_avg_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Q2 (document form): means over each customer's last 3 yearly rows."""
    return _last_n(spark, sf, "rows")


def q_last_n_periods_avg_period(spark: SparkSession, sf: str) -> DataFrame:
    """Q2 (SQL form): means over each customer's calendar window of its latest 3 years."""
    return _last_n(spark, sf, "period")


# --- Q5 / Q22a: monthly means -------------------------------------------------------------
LINE_MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def q_mean_by(spark: SparkSession, sf: str) -> DataFrame:
    """Means of four line measures and of their row total, per ship month."""
    li = load(spark, sf, "lineitem", ["l_shipdate"] + LINE_MEASURES)
    li = li.withColumn("ship_month", F.month("l_shipdate").cast("bigint"))
    out = agg.mean_by(li, ["ship_month"], LINE_MEASURES, scale=4, total_name="avg_total", fixed=2)
    return out.select("ship_month", *[_double(c).alias(c) for c in out.columns if c != "ship_month"]
                      ).orderBy(F.col("avg_total").desc())


def q_mean_global(spark: SparkSession, sf: str) -> DataFrame:
    """Ungrouped means of the four measures over the whole table (one row)."""
    li = load(spark, sf, "lineitem", LINE_MEASURES)
    out = agg.mean_by(li, [], LINE_MEASURES, scale=4, fixed=2)
    return out.select(*[_double(c).alias(c) for c in out.columns])


def q_mean_by_named(spark: SparkSession, sf: str) -> DataFrame:
    """Mean order value for two named priorities (an OR-chain of equalities)."""
    orders = load(spark, sf, "orders", ["o_orderpriority", "o_totalprice"])
    named = orders.filter((F.col("o_orderpriority") == "1-URGENT") | (F.col("o_orderpriority") == "5-LOW"))
    out = agg.mean_by(named, ["o_orderpriority"], ["o_totalprice"], scale=2, fixed=2)
    return out.select("o_orderpriority", _double("avg_o_totalprice").alias("avg_o_totalprice"))


# --- Q6: peak period per entity and measure ------------------------------------------
def _events_measures(spark: SparkSession, sf: str) -> DataFrame:
    ev = load(spark, sf, "events", ["event_type", "ts", "value", "props"])
    return ev.select("event_type", F.dayofmonth("ts").cast("bigint").alias("day"), "ts",
                     _double("value").alias("value"),
                     F.get_json_object("props", "$.k").try_cast("double").alias("k"))


def q_peak_period(spark: SparkSession, sf: str) -> DataFrame:
    """Q6: per event type, the day of the single largest value and of the largest k; ties -> earliest day."""
    out = panel.peak_period(_events_measures(spark, sf), "event_type", "day", ["value", "k"])
    return out.orderBy("event_type")


def q_pivot_measure(spark: SparkSession, sf: str) -> DataFrame:
    """Q6 (pivot form): mean value per event type, one column per quarter of the day."""
    ev = _events_measures(spark, sf).withColumn("quarter", (F.hour("ts") / 6).cast("int"))
    out = panel.pivot_measure(ev, "event_type", "quarter", [0, 1, 2, 3], "value", agg="avg", scale=4, prefix="q",
                              fixed=2)
    return out.select("event_type", *[_double(f"q{i}").alias(f"q{i}") for i in range(4)])


# --- Q9 / Q10: ratio and threshold flag ----------------------------------------------
def q_safe_ratio(spark: SparkSession, sf: str) -> DataFrame:
    """Q9: discount-to-tax ratio per line; a zero tax gives NULL."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"])
    out = score.safe_ratio(li, "l_discount", "l_tax", ["l_orderkey", "l_linenumber", "l_discount", "l_tax"],
                           name="discount_to_tax", scale=4)
    return out.orderBy(F.col("discount_to_tax").desc_nulls_last(), "l_orderkey", "l_linenumber")


def q_flag_any(spark: SparkSession, sf: str) -> DataFrame:
    """Q10: 'High Risk' when any threshold is exceeded, else 'Moderate'."""
    part = load(spark, sf, "part", ["p_partkey", "p_name", "p_size", "p_retailprice"])
    out = score.flag_any(part, [F.col("p_size") > 40, F.col("p_retailprice") > 990],
                         ["p_partkey", "p_name", "p_size", "p_retailprice"])
    return out.orderBy("health_flag", "p_partkey")


# --- Q11: duplicates and cleaning --------------------------------------------------------
def q_profile_dupes(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, distinct texts and surplus copies of the documents."""
    docs = load(spark, sf, "documents", ["text"])
    return shape.profile_dupes(docs, "text", digest=True)


def q_rows_of_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    """Every document whose whole text occurs more than once."""
    docs = load(spark, sf, "documents", ["doc_id", "text", "lang", "source", "n_chars"])
    return shape.rows_of_duplicate_keys(docs, "text", digest=True).orderBy("doc_id")


def _doc_exclusion() -> F.Column:
    return contains_text("text", "the") & (F.col("source") == "src7")


def q_dedupe_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Drop excluded rows, then whole-row duplicates, found by digests of the rows."""
    docs = load(spark, sf, "documents", ["text", "lang", "source"])
    return shape.dedupe_clean(docs, exclude=_doc_exclusion(), digest=True)


def q_dedupe_project(spark: SparkSession, sf: str) -> DataFrame:
    """Q11 (document form): distinct combinations of the projected columns."""
    part = load(spark, sf, "part", ["p_name", "p_type"])
    return shape.dedupe_project(part, ["p_name", "p_type"]).orderBy("p_name", "p_type")


def q_filter_nor(spark: SparkSession, sf: str) -> DataFrame:
    """Q11 (document form): the $nor exclusion with a case-sensitive regex; unknown names and types are kept."""
    part = load(spark, sf, "part", ["p_partkey", "p_name", "p_type"])
    key = F.col("p_partkey")
    # Input as the dumps store it: some types and names are missing.
    raw = part.select("p_partkey", F.when(key % 10 != 3, F.col("p_name")).alias("p_name"),
                      F.when(key % 6 != 0, F.col("p_type")).alias("p_type"))
    # The pipeline form: case-sensitive regex inside $nor (rows with an unknown test are kept).
    cond = exclude_both(matches("p_name", "bolt"), F.col("p_type") == "SMALL", keep_null=True)
    return raw.filter(cond).orderBy("p_partkey")


def _clean_parts(spark: SparkSession, sf: str) -> DataFrame:
    part = load(spark, sf, "part", ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"])
    excl = contains_text("p_name", "bolt") & (F.col("p_type") == "SMALL")
    return shape.dedupe_clean(part, exclude=excl)


def q_dedupe_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Mean price per type over the cleaned catalog."""
    out = agg.mean_by(_clean_parts(spark, sf), ["p_type"], ["p_retailprice"], scale=4, fixed=2)
    return out.select("p_type", _double("avg_p_retailprice").alias("avg_p_retailprice")).orderBy("avg_p_retailprice")


# --- Q12: top k -------------------------------------------------------------------------------
def q_top_k(spark: SparkSession, sf: str) -> DataFrame:
    """Q12 shape: the 10 largest orders, ties broken by key."""
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_totalprice"])
    return rank.top_k(orders, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


def q_top_k_clean(spark: SparkSession, sf: str) -> DataFrame:
    """Top 10 of the cleaned catalog (exclusion + whole-row de-dup), ties broken by every column."""
    cleaned = _clean_parts(spark, sf)
    order = [F.col("p_retailprice").desc(), F.col("p_name"), F.col("p_brand"), F.col("p_type"), F.col("p_size")]
    return rank.top_k(cleaned, order, 10)


# --- Q14 / Q15: deviation from group mean, group z-score -------------------------------
def q_group_deviation(spark: SparkSession, sf: str) -> DataFrame:
    """Q14: each part's price, its type's mean and the absolute difference."""
    part = load(spark, sf, "part", ["p_partkey", "p_type", "p_retailprice"])
    out = stats.group_deviation(part, "p_type", "p_retailprice", ["p_partkey"], scale=4,
                                avg_name="avg_type_price", delta_name="delta_from_avg", fixed=2)
    return out.select("p_partkey", "p_type", _double("avg_type_price").alias("avg_type_price"),
                      _double("delta_from_avg").alias("delta_from_avg")).orderBy(
        F.col("delta_from_avg").desc(), "p_partkey")


def q_group_zscore(spark: SparkSession, sf: str) -> DataFrame:
    """Q15: type-level z-score of the mean price against the overall mean and population sd."""
    part = load(spark, sf, "part", ["p_partkey", "p_type", "p_retailprice"])
    out = stats.group_zscore(part, "p_type", "p_retailprice", ["p_partkey", "p_retailprice"], scale=3)
    return out.orderBy("zscore", "p_partkey")


# --- Q16: hemisphere-aware winter means joined to attributes -------------------------
def q_seasonal_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Q16: winter means per nation (southern regions use Jun-Aug), with attributes and their total."""
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    cust = load(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    nation = load(spark, sf, "nation", ["n_nationkey", "n_name", "n_regionkey"])
    region = load(spark, sf, "region", ["r_regionkey", "r_name"])
    geo = join.enrich(nation, region, "n_regionkey", "r_regionkey")
    # Only the six winter months of either hemisphere can count, and at most six rows a customer meet the attributes.
    o = (orders.select("o_custkey", F.month("o_orderdate").alias("o_month"), "o_totalprice")
         .filter(F.col("o_month").isin(12, 1, 2, 6, 7, 8)).groupBy("o_custkey", "o_month")
         .agg(unit_sum("o_totalprice").alias("price_units"), F.count("o_totalprice").alias("n_prices"),
              F.count(F.lit(1)).alias("n_orders")))
    facts = join.enrich(join.enrich(o, cust, "o_custkey", "c_custkey"), geo, "c_nationkey", "n_nationkey")
    winter = panel.seasonal_mean(facts, "n_name", "o_month", ["o_totalprice", "c_acctbal"],
                                 southern=F.col("r_name").isin(*SOUTHERN_REGIONS), scale=4, extra_keys=["r_name"], fixed=2,
                                 pre={"o_totalprice": (F.col("price_units"), F.col("n_prices")),
                                      "c_acctbal": _repeated("c_acctbal", "n_orders")})
    total = F.col("avg_winter_o_totalprice") + F.col("avg_winter_c_acctbal")
    return winter.select("n_name", "r_name", _double("avg_winter_o_totalprice").alias("avg_winter_o_totalprice"),
                         _double("avg_winter_c_acctbal").alias("avg_winter_c_acctbal"),
                         total.cast("double").alias("avg_winter_total")).orderBy(F.col("avg_winter_total").desc())


# --- Q17: long-run mean joined to attributes ---------------------------------------------
def _long_run_mean(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_custkey", "o_totalprice"])
    cust = load(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    per = (orders.groupBy("o_custkey")
           .agg(F.round(fixed_mean("o_totalprice"), 2).cast("double").alias("avg_order_value")))
    return join.enrich(cust, per, "c_custkey", "o_custkey")


def q_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: each customer's long-run mean order value joined to its attributes."""
    return _long_run_mean(spark, sf).orderBy(F.col("avg_order_value").desc(), "c_custkey")


def q_corr_enriched(spark: SparkSession, sf: str) -> DataFrame:
    """Correlation, across entities, of the long-run mean with an attribute (the ``enrich`` rows, unsorted)."""
    return stats.corr_pair(_long_run_mean(spark, sf), "avg_order_value", "c_acctbal")


def q_semi_match(spark: SparkSession, sf: str) -> DataFrame:
    """Q17 (document form): customers with at least one matching order (non-empty lookup)."""
    cust = load(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderstatus"]).filter(F.col("o_orderstatus") == "P")
    return join.semi_match(cust, orders, "c_custkey", "o_custkey").orderBy("c_custkey")


# --- Q17 / Q21: correlation -----------------------------------------------------------------
def q_corr_pair(spark: SparkSession, sf: str) -> DataFrame:
    """Q17 / Q21: correlation of quantity and price per return flag."""
    li = load(spark, sf, "lineitem", ["l_returnflag", "l_quantity", "l_extendedprice"])
    return stats.corr_pair(li, "l_quantity", "l_extendedprice", keys=["l_returnflag"])


def q_corr_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """Q21: correlation matrix of the four line measures in long form."""
    li = load(spark, sf, "lineitem", LINE_MEASURES)
    return stats.corr_matrix(li, LINE_MEASURES)


# --- Q18: variation index ----------------------------------------------------------------
def q_variation_index(spark: SparkSession, sf: str) -> DataFrame:
    """Q18: sample std-devs of four measures per supplier, their mean over those known, joined to attributes."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_suppkey"] + LINE_MEASURES)
    sup = load(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"])
    # Input as the dumps store it: measures are missing here and there, and altogether for some suppliers.
    known = {m: F.col("l_suppkey") % 17 != 0 for m in LINE_MEASURES}
    known["l_quantity"] = known["l_quantity"] & (F.col("l_orderkey") % 5 != 0)
    known["l_tax"] = known["l_tax"] & (F.col("l_suppkey") % 13 != 0)
    raw = li.select("l_suppkey", *[F.when(known[m], F.col(m)).alias(m) for m in LINE_MEASURES])
    var = panel.variation_index(raw, "l_suppkey", LINE_MEASURES, skip_null=True, scale=6, require_any=True)
    out = join.enrich(var, sup, "l_suppkey", "s_suppkey")
    return out.orderBy("variation_index", F.col("s_acctbal").desc())


# --- Q19: means of means, cohorts ---------------------------------------------------------------
def q_mean_of_means(spark: SparkSession, sf: str) -> DataFrame:
    """Mean of group means across three sources."""
    cust = load(spark, sf, "customer", ["c_mktsegment", "c_acctbal"])
    sup = load(spark, sf, "supplier", ["s_nationkey", "s_acctbal"])
    part = load(spark, sf, "part", ["p_type", "p_retailprice"])
    out = agg.mean_of_means([
        (cust, ["c_mktsegment"], {"avg_value": "c_acctbal"}),
        (sup, ["s_nationkey"], {"avg_value": "s_acctbal"}),
        (part, ["p_type"], {"avg_value": "p_retailprice"}),
    ], scale=2, fixed=2)
    return out.select(_double("avg_value").alias("avg_value"))


def q_cohort_compare(spark: SparkSession, sf: str) -> DataFrame:
    """Q19d / Q19e: mean price and size for two cohorts of brands (case-insensitive)."""
    part = load(spark, sf, "part", ["p_brand", "p_retailprice", "p_size"])
    out = agg.cohort_compare(part, "p_brand", {"cohort_a": COHORT_A, "cohort_b": COHORT_B},
                             ["p_retailprice", "p_size"], scale=4, fixed=2)
    return out.select("cohort", _double("avg_p_retailprice").alias("avg_p_retailprice"),
                      _double("avg_p_size").alias("avg_p_size"))


# --- Q20: what-if risk scenarios -----------------------------------------------------------
SQL_RULE = ScenarioSpec(measures={"disc_amt": 5000.0, "tax_amt": 4000.0}, factors={"disc_amt": 0.9, "tax_amt": 0.9},
                        base="l_quantity", per=100.0, inclusive=True, reduce_only_flagged=True)
NOSQL_RULE = ScenarioSpec(measures={"disc_amt": 5000.0, "tax_amt": 4000.0},
                             factors={"disc_amt": 0.8, "tax_amt": 0.85}, base="l_quantity", per=100.0,
                             inclusive=False, reduce_only_flagged=False, positive_base_only=True,
                             ratio_first=True)


def _line_amounts(spark: SparkSession, sf: str) -> DataFrame:
    li = load(spark, sf, "lineitem", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return li.select("l_quantity", (F.col("l_extendedprice") * F.col("l_discount")).alias("disc_amt"),
                     (F.col("l_extendedprice") * F.col("l_tax")).alias("tax_amt"))


def q_scenario_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Q20 (SQL rule): baseline vs mitigated risk-score distribution with shares."""
    return score.scenario_risk(_line_amounts(spark, sf), SQL_RULE)


def q_facet_union(spark: SparkSession, sf: str) -> DataFrame:
    """Q20 (document rule): the same distribution under strict thresholds and reductions for all."""
    return score.scenario_risk(_line_amounts(spark, sf), NOSQL_RULE)


def q_share_of_total(spark: SparkSession, sf: str) -> DataFrame:
    """Q20 shape: count per status within each priority and its share."""
    orders = load(spark, sf, "orders", ["o_orderpriority", "o_orderstatus"])
    return agg.share_of_total(orders, ["o_orderpriority"], ["o_orderstatus"]).orderBy(
        "o_orderpriority", "o_orderstatus")


# --- Q21b: row totals ----------------------------------------------------------------------
def q_row_total(spark: SparkSession, sf: str) -> DataFrame:
    """One supplier's line measures with their row total, newest ship year first."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate"] + LINE_MEASURES)
    out = shape.row_total(li.filter(F.col("l_suppkey") == 7), LINE_MEASURES, "row_total")
    return out.select("l_orderkey", "l_linenumber", F.year("l_shipdate").cast("bigint").alias("ship_year"),
                      *LINE_MEASURES, "row_total").orderBy(F.col("ship_year").desc(), "l_orderkey", "l_linenumber")


def q_enrich_row_total(spark: SparkSession, sf: str) -> DataFrame:
    """Four rounded means per entity joined to its attributes, plus the total of the rounded means."""
    li = load(spark, sf, "lineitem", ["l_suppkey"] + LINE_MEASURES)
    sup = load(spark, sf, "supplier", ["s_suppkey", "s_name", "s_acctbal"])
    means = agg.mean_by(li, ["l_suppkey"], LINE_MEASURES, scale=2, fixed=2)
    cols = [f"avg_{m}" for m in LINE_MEASURES]
    out = join.enrich(shape.row_total(means, cols, "avg_total"), sup, "l_suppkey", "s_suppkey")
    return out.select("l_suppkey", "s_name", "s_acctbal", *[_double(c).alias(c) for c in cols],
                      _double("avg_total").alias("avg_total")).orderBy(F.col("avg_total").desc(), "l_suppkey")


# --- Q22: screening filters on text-stored numbers -------------------------------------------
def q_clean_zero_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in two return flags whose text-stored tax cleans to exactly 0."""
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice", "l_tax"])
    # Input as the dumps store it: the tax as text, wrapped in stray marks, or missing, blank or junk.
    k, tax = F.col("l_orderkey") % 11, F.col("l_tax").cast("string")
    text = (F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, "   ").when(k == 3, "n/a")
            .when(k == 4, F.concat(F.lit("0,00"), tax)).when(k == 5, F.concat(F.lit("\u00a0"), tax))
            .otherwise(F.concat(F.lit(" "), tax, F.lit("Â"))))
    raw = li.withColumn("tax_text", text)
    out = score.clean_zero_filter(raw, "l_returnflag", ["A", "N"], "tax_text")
    return out.select("l_orderkey", "l_linenumber", "l_returnflag", "l_extendedprice").orderBy(
        F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber")


def q_multi_threshold_filter(spark: SparkSession, sf: str) -> DataFrame:
    """Q22c (SQL form): typed thresholds plus NOT LIKE word exclusions."""
    part = load(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
    # Input as the dumps store it: prices as text, with thousands commas and marks, or missing, blank or junk; some names missing.
    k, price = F.col("p_partkey") % 7, format_fixed("p_retailprice", 2)
    text = (F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, "unknown")
            .when(k == 3, format_fixed(F.col("p_retailprice") + 1000, 2)).when(k == 5, F.concat(F.lit("0,"), price))
            .otherwise(F.concat(price, F.lit(" Â"))))
    raw = part.withColumns({"price_text": text, "p_name": F.when(F.col("p_partkey") % 10 != 9, F.col("p_name"))})
    conds = [to_number("price_text") <= 950.0, F.col("p_size") > 15, F.col("p_size") < 40]
    out = score.multi_threshold_filter(raw.filter(F.col("p_type").isin("STANDARD", "SMALL", "MEDIUM")),
                                       conds, "p_name", EXCLUDED_WORDS)
    return out.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice").orderBy("p_type", "p_retailprice",
                                                                                           "p_partkey")


def q_multi_threshold_regex(spark: SparkSession, sf: str) -> DataFrame:
    """The pipeline form of the screen: typed thresholds and one case-insensitive ``$not $regex``."""
    part = load(spark, sf, "part", ["p_partkey", "p_name", "p_type", "p_size", "p_retailprice"])
    # Input as the dumps store it: the price as text, or blank, junk or missing.
    k = F.col("p_partkey") % 5
    text = (F.when(k == 0, "  ").when(k == 1, "12.5.7").when(k == 2, F.lit(None))
            .otherwise(F.concat(F.lit(" "), F.col("p_retailprice").cast("string"))))
    raw = part.withColumn("price_text", text)
    conds = [F.col("p_type").isin("STANDARD", "SMALL", "MEDIUM"), to_number("price_text") <= 950.0,
             F.col("p_size") > 15, F.col("p_size") < 40]
    out = score.multi_threshold_filter(raw, conds, "p_name", exclude_regex=EXCLUDED_PATTERN)
    return out.select("p_partkey", "p_name", "p_type", "p_size", "p_retailprice").orderBy("p_type", "p_retailprice",
                                                                                           "p_partkey")


# --- Q23: period means, tiers, profiles, priority classes -------------------------------------
def _customer_period_mean(spark: SparkSession, sf: str) -> DataFrame:
    cust = load(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"])
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    facts = orders.select("o_custkey", F.year("o_orderdate").alias("o_year"), "o_totalprice")
    # Input as the dumps store it: some segments are empty, missing or blank.
    k = F.col("c_custkey") % 8
    cust = cust.withColumn("c_mktsegment", F.when(k == 0, "").when(k == 1, F.lit(None)).when(k == 2, "  ")
                           .otherwise(F.col("c_mktsegment")))
    return panel.period_mean_enrich(cust, facts, "c_custkey", "o_custkey", "o_year", 1996, 2000, ["o_totalprice"],
                                    ["c_name", "c_mktsegment", "c_acctbal"], require=["c_mktsegment"], scale=2,
                                    fixed=2)


def q_period_mean_enrich(spark: SparkSession, sf: str) -> DataFrame:
    """Customer attributes with the mean order value over 1996-2000; customers without a segment are left out."""
    out = _customer_period_mean(spark, sf)
    return out.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal",
                      _double("avg_o_totalprice").alias("avg_o_totalprice")).orderBy(
        F.col("c_acctbal").desc(), "c_custkey")


def q_period_mean_lexical(spark: SparkSession, sf: str) -> DataFrame:
    """Q23a on text years: the range '1996' to '2000' compares as text, so a year with a trailing blank sorts after it."""
    cust = load(spark, sf, "customer", ["c_custkey", "c_name"])
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate", "o_totalprice"])
    # Input as the dumps store it: the year as text, some with a blank behind.
    year = F.concat(F.date_format("o_orderdate", "yyyy"), F.when(F.col("o_orderkey") % 13 == 0, " ").otherwise(""))
    facts = orders.select("o_custkey", year.alias("year_text"), "o_totalprice")
    out = panel.period_mean_enrich(cust, facts, "c_custkey", "o_custkey", "year_text", "1996", "2000",
                                   ["o_totalprice"], ["c_name"], scale=2, fixed=2, lexical=True)
    return out.select("c_custkey", "c_name", _double("avg_o_totalprice").alias("avg_o_totalprice")).orderBy("c_custkey")


def _customer_mean_raw(spark: SparkSession, sf: str) -> DataFrame:
    cust = load(spark, sf, "customer", ["c_custkey", "c_acctbal", "c_mktsegment"])
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    per = (orders.filter(F.year("o_orderdate").between(1996, 2000))
           .groupBy("o_custkey").agg(fixed_mean("o_totalprice").alias("mean_price")))
    return join.enrich(cust, per, "c_custkey", "o_custkey")


def q_tier_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Customers tiered by their 1996-2000 mean order value; summary per tier."""
    per = _customer_mean_raw(spark, sf)
    lo, hi = PRICE_TIERS
    tier = score.classify([(F.col("mean_price") < lo, "low"),
                           (F.col("mean_price").between(lo, hi), "medium")], "high")
    per = per.withColumn("mean_price_2", F.round(F.col("mean_price"), 2))
    out = agg.tier_summary(per, tier, {"avg_c_acctbal": "c_acctbal", "avg_mean_price": "mean_price_2"},
                           minmax="mean_price_2", scale=2, fixed=2)
    return out.select("tier", "n_entities", _double("avg_c_acctbal").alias("avg_c_acctbal"),
                      _double("avg_mean_price").alias("avg_mean_price"),
                      _double("min_mean_price_2").alias("min_mean_price"),
                      _double("max_mean_price_2").alias("max_mean_price")).orderBy(F.col("avg_c_acctbal").desc())


def q_tier_fanout(spark: SparkSession, sf: str) -> DataFrame:
    """Q23d: balance tiers over the customer-orders join (fan-out kept, distinct count), orders summed before it."""
    cust = load(spark, sf, "customer", ["c_custkey", "c_acctbal"])
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_totalprice"])
    tiered = cust.withColumn("tier", score.classify([(F.col("c_acctbal") > 6000.0, "upper"),
                                                     (F.col("c_acctbal") >= 2000.0, "middle")], "lower"))
    o = (orders.filter(F.year("o_orderdate").between(1996, 2000)).groupBy("o_custkey")
         .agg(unit_sum("o_totalprice").alias("price_units"), F.count("o_totalprice").alias("n_prices"),
              F.count(F.lit(1)).alias("n_orders")))
    joined = join.enrich(tiered, o, "c_custkey", "o_custkey")
    out = agg.tier_summary(joined, F.col("tier"), {}, distinct_key="c_custkey", scale=2, fixed=2,
                           pre={"avg_c_acctbal": _repeated("c_acctbal", "n_orders"),
                                "avg_o_totalprice": (F.col("price_units"), F.col("n_prices"))})
    out = out.select("tier", "n_entities", _double("avg_c_acctbal").alias("avg_c_acctbal"),
                     _double("avg_o_totalprice").alias("avg_o_totalprice"))
    return out.orderBy(F.col("avg_c_acctbal").desc())


def q_profile_measure(spark: SparkSession, sf: str) -> DataFrame:
    """Two-source profile of one measure with a conditional count."""
    part = load(spark, sf, "part", ["p_retailprice"])
    sup = load(spark, sf, "supplier", ["s_acctbal"])
    out = agg.profile_measure([("part", part, "p_retailprice"), ("supplier", sup, "s_acctbal")],
                              high=950.0, scale=2, fixed=2)
    return out.select("source", "total_items", *[_double(c).alias(c) for c in
                                                 ["avg_value", "max_value", "min_value", "stddev_value"]],
                      "high_items")


def q_priority_class(spark: SparkSession, sf: str) -> DataFrame:
    """Q23e: rule classes over the per-customer mean, HAVING mean > 200 000."""
    per = _customer_mean_raw(spark, sf).filter(F.col("mean_price") > 200000)
    first, second, default = ACTION_LABELS
    rules = [((F.col("mean_price") > 275000) & (F.col("c_acctbal") < 0), first),
             ((F.col("mean_price") > 250000) & (F.col("c_acctbal") < 3000), second)]
    out = score.priority_class(per, rules, default, name="action")
    return out.select("c_custkey", "c_mktsegment", "c_acctbal",
                      F.round(F.col("mean_price"), 2).cast("double").alias("avg_o_totalprice"),
                      "action").orderBy("action", "c_acctbal", "c_custkey")


# --- IA: counts, sums, labels, time split, buckets, 4-table top-k -------------------------------
def q_count_by(spark: SparkSession, sf: str) -> DataFrame:
    """Customers per market segment."""
    cust = load(spark, sf, "customer", ["c_mktsegment"])
    return agg.count_by(cust, ["c_mktsegment"], name="n_customers")


def q_count_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Number of market segments."""
    cust = load(spark, sf, "customer", ["c_mktsegment"])
    return agg.count_distinct_of(cust, "c_mktsegment", "num_segments")


def q_count_levels(spark: SparkSession, sf: str) -> DataFrame:
    """Order counts per (status, priority) and per (status, priority, late year), side by side."""
    orders = load(spark, sf, "orders", ["o_orderstatus", "o_orderpriority", "o_orderdate"])
    o = orders.withColumn("late_year", F.year("o_orderdate") >= 1999)
    out = agg.count_levels(o, ["o_orderstatus", "o_orderpriority"], ["late_year"],
                           names=("records_status_priority", "records_with_year"))
    return out.select("o_orderstatus", "o_orderpriority", "records_status_priority",
                      F.col("late_year").cast("string").alias("late_year"), "records_with_year").orderBy(
        "o_orderstatus", F.col("late_year").desc(), F.col("records_status_priority").desc())


def q_sum_by_exact(spark: SparkSession, sf: str) -> DataFrame:
    """I3 (version B): exact totals per (status, priority)."""
    orders = load(spark, sf, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    out = agg.sum_by(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", name="total_sales", fixed=2)
    return out.select("o_orderstatus", "o_orderpriority", _double("total_sales").alias("total_sales")).orderBy(
        "o_orderstatus")


def q_sum_by_rounded(spark: SparkSession, sf: str) -> DataFrame:
    """I3 (version A): totals of per-order values rounded half-up."""
    orders = load(spark, sf, "orders", ["o_orderstatus", "o_orderpriority", "o_totalprice"])
    out = agg.sum_by(orders, ["o_orderstatus", "o_orderpriority"], "o_totalprice", rounding="each_half_up",
                     name="total_sales")
    return out.select("o_orderstatus", "o_orderpriority", F.col("total_sales").cast("bigint")).orderBy(
        "o_orderstatus")


def _priority_flags(spark: SparkSession, sf: str) -> DataFrame:
    orders = load(spark, sf, "orders", ["o_orderpriority", "o_orderstatus", "o_totalprice", "o_custkey"])
    # Input as the dumps store it: one-hot text flags 'True' / 'False'.
    flag = lambda cond: F.when(cond, F.lit("True")).otherwise(F.lit("False"))
    return orders.select(
        flag(F.col("o_orderpriority") == "1-URGENT").alias("priority_urgent"),
        flag(F.col("o_orderpriority") == "2-HIGH").alias("priority_high"),
        flag(F.col("o_orderstatus") == "F").alias("status_filled"),
        flag(F.col("o_orderstatus") != "P").alias("is_settled"),
        (F.col("o_totalprice") / F.lit(10000.0)).alias("price_10k"),
        (F.col("o_custkey") % 10).cast("double").alias("cust_digit"))


def q_onehot_label(spark: SparkSession, sf: str) -> DataFrame:
    """I4: text one-hot flags folded to labels; half-up means formatted; custom label order."""
    raw = _priority_flags(spark, sf).filter(F.col("is_settled") == "True")
    labelled = raw.select(
        onehot_label([("priority_urgent", "urgent"), ("priority_high", "high")], "routine").alias("priority_class"),
        onehot_label([("status_filled", "filled")], "open").alias("status"),
        "price_10k", "cust_digit")
    out = labelled.groupBy("priority_class", "status").agg(
        format_fixed(F.avg(floor_half_up("price_10k")), 4).alias("avg_price_10k"),
        format_fixed(F.avg(floor_half_up("cust_digit")), 4).alias("avg_cust_digit"))
    return out.orderBy(ordinal_position("priority_class", PRIORITY_ORDER), "status")


def q_time_split_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Spend before and after 12 from HH:mm text, invalid hours dropped."""
    ev = load(spark, sf, "events", ["event_id", "ts", "value"])
    # Input as the dumps store it: time of day as text, with hours from 24 on, below 0, junk, blanks and gaps.
    k = F.col("event_id") % 9
    text = (F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 2, "25:10").when(k == 3, "24:00").when(k == 4, "ab:cd")
            .when(k == 5, F.date_format("ts", "H:mm")).when(k == 6, "-3:10").otherwise(F.date_format("ts", "HH:mm")))
    out = panel.time_split_sum(ev.select(text.alias("time_text"), "value"), parse_hour("time_text"), "value", fixed=2)
    return out.select("period", _double("amt").alias("amt")).orderBy("amt")


def q_bucket_scaffold(spark: SparkSession, sf: str) -> DataFrame:
    """Means per size band from a 0-6 scaffold, empty bands kept."""
    part = load(spark, sf, "part", ["p_size", "p_retailprice"])
    p = part.select((F.col("p_size") / F.lit(10.0)).alias("size_10"), "p_retailprice", "p_size")
    out = join.bucket_scaffold(p, "size_10", ["p_retailprice", "p_size"], 0, 7, scale=2, label="size_band", fixed=2)
    return out.select("size_band", *[_double(c).alias(c) for c in ["avg_p_retailprice", "avg_p_size"]])


def q_top_k_per_group(spark: SparkSession, sf: str) -> DataFrame:
    """Four-table join -> month -> per (month, customer, supplier) totals -> top 3 per month.

    The order date arrives as ``d/m/Y`` text; it is parsed once per order,
    before the order is joined to its (several) line items.  The customer is
    matched through the number behind the ``Customer#`` prefix of its name;
    customer and supplier keys are unique.
    Output is sorted by month number, which is not itself returned.
    """
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_suppkey", "l_extendedprice", "l_discount"])
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey", "o_orderdate"])
    cust = load(spark, sf, "customer", ["c_custkey", "c_name", "c_mktsegment"])
    sup = load(spark, sf, "supplier", ["s_suppkey", "s_name"])
    raw_orders = orders.select("o_orderkey", "o_custkey", F.date_format("o_orderdate", "d/M/yyyy").alias("date_text"))
    o = raw_orders.select("o_orderkey", "o_custkey", F.month(parse_dmy("date_text")).cast("bigint").alias("month_no"))
    c = cust.select(id_from_prefixed("c_name", 9).alias("c_key"), "c_custkey", "c_mktsegment")
    facts = join.enrich(li, o, "l_orderkey", "o_orderkey")
    # Narrow keys and sums only go through the shuffles; totals are decimals of whole cents.
    aggregated = facts.groupBy("month_no", "o_custkey", "l_suppkey").agg(
        unit_sum("l_discount").alias("disc_units"), F.count(F.lit(1)).alias("trans_amt"),
        unit_sum("l_extendedprice").alias("money_units"))
    # Rows without a customer or a supplier go before the ranking, as the inner joins would have it.
    aggregated = join.enrich(aggregated, c.select("c_key", "c_custkey"), "o_custkey", "c_key")
    aggregated = join.semi_match(aggregated, sup, "l_suppkey", "s_suppkey")
    ranked = rank.top_k_per_group(aggregated, ["month_no"], [F.col("money_units").desc(), F.col("c_custkey"),
                                                             F.col("l_suppkey")], 3)
    ranked = ranked.withColumns({"avg_disc": units_mean("disc_units", "trans_amt"),
                                 "total_money": units_to_fixed("money_units")})
    # Attributes are attached to the few ranked rows.
    ranked = join.enrich(ranked, c.select("c_custkey", "c_mktsegment"), "c_custkey")
    ranked = join.enrich(ranked, sup, "l_suppkey", "s_suppkey")
    month_name = F.upper(F.date_format(F.make_date(F.lit(2000), F.col("month_no").cast("int"), F.lit(1)), "MMM"))
    s_prefix, _ = split_pair(F.col("s_name"), "#")
    out = ranked.select(month_name.alias("trans_month"), "c_custkey", "l_suppkey", "c_mktsegment",
                        s_prefix.alias("s_prefix"),
                        format_fixed(F.col("avg_disc"), 6).alias("avg_disc"), "trans_amt",
                        format_fixed(F.col("total_money"), 2).alias("total_money"),
                        F.col("rank_no").cast("bigint").alias("rank_no"), "month_no")
    return out.orderBy("month_no", "rank_no").drop("month_no")


def q_fanout_sum(spark: SparkSession, sf: str) -> DataFrame:
    """Money per segment over a many-to-many join on a derived key, whose customer side repeats every key."""
    orders = load(spark, sf, "orders", ["o_custkey", "o_totalprice"])
    cust = load(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    # Input as the dumps store it: the store of a sale as a prefixed id, several customers to a store.
    raw = orders.select(F.concat(F.lit("STORE-"), F.col("o_custkey") % 97).alias("store_text"), "o_totalprice")
    fact = raw.select(id_from_prefixed("store_text", 6).alias("store"), to_units("o_totalprice").alias("money_units"))
    dim = cust.select((F.col("c_custkey") % 97).alias("store"), "c_mktsegment")
    out = join.fanout_sum(fact, dim, "store", ["money_units"], ["c_mktsegment"])
    return out.select("c_mktsegment", "n_rows", units_to_fixed("money_units").cast("double").alias("total_money")).orderBy(
        "c_mktsegment")


def q_distinct_union(spark: SparkSession, sf: str) -> DataFrame:
    """The distinct (nation, in debt) pairs of two sources (UNION without ALL)."""
    cust = load(spark, sf, "customer", ["c_nationkey", "c_acctbal"])
    sup = load(spark, sf, "supplier", ["s_nationkey", "s_acctbal"])
    return join.distinct_union(
        cust.select(F.col("c_nationkey").alias("nationkey"), (F.col("c_acctbal") < 0).cast("string").alias("in_debt")),
        sup.select(F.col("s_nationkey").alias("nationkey"), (F.col("s_acctbal") < 0).cast("string").alias("in_debt"))
    ).orderBy("nationkey", "in_debt")


def q_coalesce_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Key drift: customers per segment, where two dumps name the same key differently and some rows lack it."""
    cust = load(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    # Input as the dumps store it: one key per dump, missing in every tenth row of the second.
    one = cust.filter(F.col("c_custkey") % 2 == 1).select(F.col("c_mktsegment").alias("Segment"))
    two = cust.filter(F.col("c_custkey") % 2 == 0).select(
        F.when(F.col("c_custkey") % 10 != 0, F.col("c_mktsegment")).alias("mkt_segment"))
    both = one.unionByName(two, allowMissingColumns=True)
    named = both.select(coalesce_existing(both, ["Segment", "mkt_segment", "seg"]).alias("segment"))
    return agg.count_by(named, ["segment"], name="n_customers").orderBy("segment")


# --- lookups kept as arrays, ordered lists, facets, many correlations -----------------------
NESTED_ROWS = 8   # matches to a row of the nested lookup
LIST_ROWS = 10    # rows of the ordered list, as the source keeps them


def q_lookup_nested(spark: SparkSession, sf: str) -> DataFrame:
    """Q16 / Q17 (document form): every customer with its orders as arrays, in chunks; the keys and statuses as arrays of a field."""
    cust = load(spark, sf, "customer", ["c_custkey", "c_mktsegment"])
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"])
    orders = orders.withColumn("cents", to_units("o_totalprice"))
    out = nested.lookup_nested(cust, orders, "c_custkey", "o_custkey", "o_orderkey", ["o_orderkey", "o_orderstatus", "cents"],
                               as_name="orders", chunk_rows=NESTED_ROWS)
    return out.select("c_custkey", "c_mktsegment", "chunk", F.size("orders").cast("bigint").alias("n_orders"),
                      F.to_json("orders").alias("orders"), F.to_json("orders.o_orderkey").alias("order_keys"),
                      F.array_join("orders.o_orderstatus", "").alias("statuses"))


def q_lookup_nonempty(spark: SparkSession, sf: str) -> DataFrame:
    """Q17: the non-empty-array test on a nested lookup: parts with their large sales, parts without any dropped."""
    part = load(spark, sf, "part", ["p_partkey", "p_brand"])
    li = load(spark, sf, "lineitem", ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]).filter(F.col("l_quantity") >= 45)
    sale = F.col("l_orderkey") * 8 + F.col("l_linenumber")   # a unique number of the line
    li = li.select("l_partkey", sale.alias("sale"), F.col("l_quantity").cast("bigint").alias("quantity"))
    out = nested.lookup_nested(part, li, "p_partkey", "l_partkey", "sale", ["sale", "quantity"], as_name="sales",
                               chunk_rows=NESTED_ROWS, how="inner")
    return out.select("p_partkey", "p_brand", "chunk", F.to_json("sales").alias("sales"))


def q_last_list(spark: SparkSession, sf: str) -> DataFrame:
    """Q2 (document form): each customer's last orders as an array; its slices, ends, and exact means of a field."""
    orders = load(spark, sf, "orders", ["o_custkey", "o_orderdate", "o_orderkey", "o_totalprice"])
    orders = orders.select("o_custkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), "o_orderkey",
                           "o_totalprice", to_units("o_totalprice").alias("cents"))
    out = nested.last_list(orders, ["o_custkey"], ["day", "o_orderkey"], ["cents", "o_totalprice"], LIST_ROWS)
    price = "last.o_totalprice"
    slim = F.transform("last", lambda s: F.struct(s["day"].alias("day"), s["o_orderkey"].alias("o_orderkey"), s["cents"].alias("cents")))
    return out.select(
        "o_custkey", F.size("last").cast("bigint").alias("n_last"), F.to_json(slim).alias("last"),
        F.to_json(lists.tail("last.o_orderkey", 3)).alias("last_3"), F.to_json(lists.head("last.o_orderkey", 2)).alias("first_2"),
        lists.element("last.o_orderkey", 0).alias("oldest"), lists.element("last.o_orderkey", -1).alias("newest"),
        lists.element("last.o_orderkey", 9).alias("tenth"),
        F.round(lists.mean_of(price), 2).cast("double").alias("avg_price"),
        F.round(lists.mean_of(lists.tail(price, 3)), 2).cast("double").alias("avg_price_3"))


def q_facets(spark: SparkSession, sf: str) -> DataFrame:
    """Q8 (document form): four groupings of the line items side by side, from one scan."""
    li = load(spark, sf, "lineitem", ["l_returnflag", "l_linestatus", "l_shipdate", "l_linenumber", "l_quantity", "l_extendedprice"])
    li = li.withColumn("ship_month", F.month("l_shipdate").cast("bigint"))
    out = facets(li, {"by_flag": ["l_returnflag", "l_linestatus"], "by_month": ["ship_month"], "by_line": ["l_linenumber", "l_returnflag"],
                      "all": []},
                 {"n_lines": F.count(F.lit(1)), "quantity": fixed_sum("l_quantity"), "avg_price": fixed_mean("l_extendedprice"),
                  "max_price": F.max("l_extendedprice")})
    return out.withColumns({"quantity": _double("quantity"), "avg_price": F.round("avg_price", 4).cast("double")})


CORR_COLUMNS = 200


def q_corr_tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Q19: the correlation matrix of two hundred derived columns, in tiles; some rows lack some of them."""
    orders = load(spark, sf, "orders", ["o_orderkey", "o_custkey"])
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    cols = {f"c{k}": F.when((key + k) % 23 != 0, (key * (2 * k + 1) + cust * (k % 7)) % (89 + k) + (cust % 10) * (k % 5))
            for k in range(CORR_COLUMNS)}
    return corr_tiles(orders.select(*[c.alias(n) for n, c in cols.items()]), list(cols), scale=6)


# --- sketches, interval tables, caseless keys, open pivots, exports ------------------------------
def q_distinct_sketch(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct parts sold a month and a year from sketches made a day, with the exact count beside them.

    ``within_bound``: the estimate is off by no more than the sketch's bound;
    ``merged_is_whole``: merged states say the same as one pass over all rows.
    """
    li = load(spark, sf, "lineitem", ["l_shipdate", "l_partkey"])
    days = sketch.sketch_by(li, [F.to_date("l_shipdate").alias("day")], "l_partkey")
    parts = []
    for form in ("yyyy-MM", "yyyy"):
        period = F.date_format("l_shipdate", form).alias("period")
        merged = sketch.merge_sketches(days, [F.date_format("day", form).alias("period")])
        whole = sketch.sketch_by(li, [period], "l_partkey", name="whole")
        exact = li.groupBy(period).agg(F.count_distinct("l_partkey").alias("n_parts"))
        parts.append(exact.join(merged, "period").join(whole, "period"))
    both = parts[0].unionByName(parts[1])
    off = F.abs(sketch.estimate() - F.col("n_parts"))
    return both.select("period", "n_parts", (off <= sketch.error_bound(F.col("n_parts"))).alias("within_bound"),
                       (sketch.estimate() == sketch.estimate("whole")).alias("merged_is_whole"))


TIER_WIDTH = 300.0


def q_range_tiers(spark: SparkSession, sf: str) -> DataFrame:
    """Q23b / Q23d: orders in thousands of overlapping price tiers, some without an upper end, summed up by brand."""
    part = load(spark, sf, "part", ["p_partkey", "p_brand"])
    lo = (F.col("p_partkey") - 1) * F.lit(TIER_WIDTH)
    hi = F.when(F.col("p_partkey") % 1000 != 0, lo + TIER_WIDTH + (F.col("p_partkey") % 5) * F.lit(150.0))
    tiers = part.select("p_brand", lo.alias("lo"), hi.alias("hi"))
    orders = load(spark, sf, "orders", ["o_totalprice"]).withColumn("cents", to_units("o_totalprice"))
    found = range_lookup(orders, "o_totalprice", tiers, "lo", "hi", ["p_brand"], width=TIER_WIDTH, levels=3)
    return found.groupBy("p_brand").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("cents").alias("cents"))


def _mixed_case(c: str, key: str) -> F.Column:
    """Input as the dumps store it: one name in several spellings."""
    return F.when(F.col(key) % 3 == 0, F.upper(c)).when(F.col(key) % 3 == 1, F.lower(c)).otherwise(F.col(c))


def q_collate_group(spark: SparkSession, sf: str) -> DataFrame:
    """Q12: parts and their mean price per type, whatever the type's case; named by its smallest spelling."""
    part = load(spark, sf, "part", ["p_partkey", "p_type", "p_retailprice"])
    raw = part.select(_mixed_case("p_type", "p_partkey").alias("type_text"), "p_retailprice")
    out = collate.group_caseless(raw, "type_text", {"n_parts": F.count(F.lit(1)), "avg_price": F.round(fixed_mean("p_retailprice"), 4)})
    return out.withColumn("avg_price", _double("avg_price"))


def q_collate_distinct(spark: SparkSession, sf: str) -> DataFrame:
    """Q11: the distinct (brand, type) pairs whatever their case, each in a spelling that occurs."""
    part = load(spark, sf, "part", ["p_partkey", "p_brand", "p_type"])
    raw = part.select(_mixed_case("p_brand", "p_partkey").alias("brand_text"), _mixed_case("p_type", "p_partkey").alias("type_text"))
    return collate.distinct_caseless(raw, ["brand_text", "type_text"])


def q_collate_sort(spark: SparkSession, sf: str) -> DataFrame:
    """Q13: the first 25 parts by name whatever its case."""
    part = load(spark, sf, "part", ["p_partkey", "p_name"])
    raw = part.select("p_partkey", _mixed_case("p_name", "p_partkey").alias("name_text"))
    return collate.sort_caseless(raw, "name_text", "p_partkey").limit(25)


def q_collate_join(spark: SparkSession, sf: str) -> DataFrame:
    """Q16: customers matched to nations by a nation name in any case."""
    nation = load(spark, sf, "nation", ["n_nationkey", "n_name"])
    cust = load(spark, sf, "customer", ["c_custkey", "c_nationkey", "c_acctbal"])
    raw = join.enrich(cust, nation, "c_nationkey", "n_nationkey").select(
        _mixed_case("n_name", "c_custkey").alias("nation_text"), to_units("c_acctbal").alias("cents"))
    per = collate.group_caseless(raw, "nation_text", {"n_customers": F.count(F.lit(1)), "cents": F.sum("cents")})
    return collate.join_caseless(per, nation, "nation_text", "n_name").select("n_nationkey", "n_name", "n_customers", "cents")


PIVOT_COLUMNS = 5


def q_pivot_open(spark: SparkSession, sf: str) -> DataFrame:
    """Q9: order value per priority with a column for each of the five busiest months, found at run time, and a map of the rest."""
    orders = load(spark, sf, "orders", ["o_orderdate", "o_orderkey", "o_orderpriority", "o_totalprice"])
    # Input as the dumps store it: some dates are missing.
    raw = orders.select("o_orderpriority", F.when(F.col("o_orderkey") % 50 != 0, F.date_format("o_orderdate", "yyyy-MM")).alias("month"),
                        to_units("o_totalprice").alias("cents"))
    wide = panel.pivot_open(raw, "o_orderpriority", "month", F.sum("cents"), max_columns=PIVOT_COLUMNS)
    heavy = [c for c in wide.columns if c not in ("o_orderpriority", "part", "rest")]
    values = F.array(*[F.col(f"`{c}`").cast("string") for c in heavy]).cast("array<string>")
    return wide.select("o_orderpriority", "part", F.lit(",".join(heavy)).alias("months"), F.array_join(values, ",", "null").alias("cents"),
                       F.size("rest").cast("bigint").alias("n_rest"), F.to_json("rest").alias("rest"))


EXPORT_ROWS = 5000


def q_export_roundtrip(spark: SparkSession, sf: str) -> DataFrame:
    """The source's CSV export, whole texts included: written in key ranges with a manifest, checked, and read again."""
    docs = load(spark, sf, "documents")
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/tabulant-export-{uuid.uuid4().hex}"
    export.export_files(docs, path, "doc_id", rows_per_file=EXPORT_ROWS)
    back = export.read_verified(spark, path, docs.schema, "doc_id")
    return back.select("doc_id", "lang", "source", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


# Built with jobs of their own: column names have to be known, files to be written, what is broadcast to be counted.
EAGER = {"pivot_open", "export_roundtrip", "dedupe_clean"}

QUERIES: dict[str, Query] = {
    "first_last_delta": q_first_last_delta,
    "first_last_delta_half_even": q_first_last_delta_half_even,
    "last_n_periods_avg_rows": q_last_n_periods_avg_rows,
    "last_n_periods_avg_period": q_last_n_periods_avg_period,
    "mean_by": q_mean_by,
    "mean_by_named": q_mean_by_named,
    "mean_global": q_mean_global,
    "peak_period": q_peak_period,
    "pivot_measure": q_pivot_measure,
    "safe_ratio": q_safe_ratio,
    "flag_any": q_flag_any,
    "profile_dupes": q_profile_dupes,
    "rows_of_duplicate_keys": q_rows_of_duplicate_keys,
    "dedupe_clean": q_dedupe_clean,
    "dedupe_project": q_dedupe_project,
    "filter_nor": q_filter_nor,
    "dedupe_mean": q_dedupe_mean,
    "top_k": q_top_k,
    "top_k_clean": q_top_k_clean,
    "group_deviation": q_group_deviation,
    "group_zscore": q_group_zscore,
    "seasonal_mean": q_seasonal_mean,
    "enrich": q_enrich,
    "corr_enriched": q_corr_enriched,
    "semi_match": q_semi_match,
    "corr_pair": q_corr_pair,
    "corr_matrix": q_corr_matrix,
    "variation_index": q_variation_index,
    "mean_of_means": q_mean_of_means,
    "cohort_compare": q_cohort_compare,
    "scenario_risk": q_scenario_risk,
    "facet_union": q_facet_union,
    "share_of_total": q_share_of_total,
    "row_total": q_row_total,
    "enrich_row_total": q_enrich_row_total,
    "clean_zero_filter": q_clean_zero_filter,
    "multi_threshold_filter": q_multi_threshold_filter,
    "multi_threshold_regex": q_multi_threshold_regex,
    "period_mean_enrich": q_period_mean_enrich,
    "tier_summary": q_tier_summary,
    "tier_fanout": q_tier_fanout,
    "profile_measure": q_profile_measure,
    "priority_class": q_priority_class,
    "count_by": q_count_by,
    "count_distinct": q_count_distinct,
    "count_levels": q_count_levels,
    "sum_by_exact": q_sum_by_exact,
    "sum_by_rounded": q_sum_by_rounded,
    "onehot_label": q_onehot_label,
    "time_split_sum": q_time_split_sum,
    "bucket_scaffold": q_bucket_scaffold,
    "top_k_per_group": q_top_k_per_group,
    "period_mean_lexical": q_period_mean_lexical,
    "fanout_sum": q_fanout_sum,
    "distinct_union": q_distinct_union,
    "coalesce_drift": q_coalesce_drift,
    "lookup_nested": q_lookup_nested,
    "lookup_nonempty": q_lookup_nonempty,
    "last_list": q_last_list,
    "facets": q_facets,
    "corr_tiles": q_corr_tiles,
    "distinct_sketch": q_distinct_sketch,
    "range_tiers": q_range_tiers,
    "collate_group": q_collate_group,
    "collate_distinct": q_collate_distinct,
    "collate_sort": q_collate_sort,
    "collate_join": q_collate_join,
    "pivot_open": q_pivot_open,
    "export_roundtrip": q_export_roundtrip,
}
