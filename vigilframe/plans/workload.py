"""Business metrics the monitor exists to answer, as functions of whole tables.

Facts are aggregated to their join key before they meet a dimension, so a join
moves one row per key and a hot key costs nothing extra.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.functions.scalars import ntz, on_day
from vigilframe.plans.skew import (
    null_safe_join,
    bucketed,
    exact_percentiles,
    lag_in_buckets,
    newest_per_key,
    sessions_in_buckets,
)
from vigilframe.session import written



def rows() -> Column:
    return F.count(F.lit(1))


def revenue() -> Column:
    return F.sum(F.col("l_extendedprice") * (F.lit(1.0) - F.col("l_discount")))


def between(ts: str, start: str, end: str) -> Column:
    return (F.col(ts) >= ntz(start)) & (F.col(ts) < ntz(end))


def share_of_all(groups: DataFrame, amount: str, target: str = "share_pct") -> DataFrame:
    """Share in the sum of all groups; groups are written once, so their table is scanned once."""
    groups = written(groups, "groups")
    total = groups.agg(F.sum(amount)).scalar()
    return groups.withColumn(target, F.round(F.col(amount) * 100.0 / total, 4))


# --- categories, stock ------------------------------------------------------------


def active_categories(part):
    return part.where(F.col("p_size") > 0).select("p_type").distinct()


def category_structure(region, nation):
    """Children of each parent, in name order; a parent has few children."""
    children = nation.groupBy("n_regionkey").agg(
        rows().alias("children"), F.sort_array(F.collect_list("n_name")).alias("names")
    )
    return region.join(children, region.r_regionkey == children.n_regionkey, "left").select(
        "r_name",
        F.coalesce("children", F.lit(0).cast("bigint")).alias("children"),
        F.array_join("names", ",").alias("child_names"),
    )


def hierarchy(nodes: DataFrame) -> DataFrame:
    """Depth and path of every node of a parent-child table (id, parent_id, name).

    Every row holds a stretch of path, from its node up to just below ``_top``. Each round joins
    it to the stretches of ``_top`` itself, which doubles its length, so the rounds grow with
    the logarithm of the depth. Stretches that would meet a node twice go, so a cycle ends
    by itself. A node no root leads to has neither depth nor path: its parent is absent, or it
    hangs on a cycle. A node listed under several parents has a row for each path.
    """
    rows = nodes.select(
        "id", F.col("parent_id").alias("_top"), F.array("id").alias("_seen"), F.array("name").alias("_names")
    )
    rows = written(rows, "paths")
    while not (unfinished := rows.where("_top is not null")).isEmpty():
        above = rows.select(
            F.col("id").alias("_top"), F.col("_top").alias("_next"), F.col("_seen").alias("_before"), F.col("_names").alias("_named")
        )
        longer = (
            unfinished.join(above, "_top")
            .where(~F.arrays_overlap("_seen", "_before"))
            .select(
                "id", F.col("_next").alias("_top"), F.concat("_before", "_seen").alias("_seen"), F.concat("_named", "_names").alias("_names")
            )
        )
        rows = written(rows.where("_top is null").unionByName(longer), "paths")
    path = F.when(F.size("_seen") == 1, F.col("_names")[0]).otherwise(F.array_join("_names", "/"))
    found = rows.select("id", (F.size("_seen") - 1).alias("depth"), path.alias("path"))
    lost = nodes.where("parent_id is not null").join(found, "id", "left_anti").select(
        "id", F.lit(None).cast("int").alias("depth"), F.lit(None).cast("string").alias("path")
    )
    return found.unionByName(lost)


def products_per_category(part):
    return part.groupBy("p_type").agg(
        rows().alias("products"), F.min("p_size").alias("min_size"), F.max("p_size").alias("max_size")
    )


def stock(lineitem):
    reserved = F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0.0)
    return lineitem.groupBy("l_partkey").agg(
        F.sum("l_quantity").alias("quantity"), F.sum(reserved).alias("reserved")
    )


def reorder_needed(lineitem, level: float):
    return stock(lineitem).where(F.col("reserved") <= level).select("l_partkey", "reserved")


def warehouse_distribution(lineitem):
    groups = lineitem.groupBy("l_suppkey").agg(F.sum("l_quantity").alias("quantity"))
    return share_of_all(groups, "quantity")


# --- sales ------------------------------------------------------------------------


def units_sold(lineitem, start, end):
    return (
        lineitem.where(between("l_shipdate", start, end))
        .groupBy("l_partkey")
        .agg(F.sum("l_quantity").alias("units"))
    )


def order_revenue(lineitem):
    return lineitem.groupBy("l_orderkey").agg(F.round(revenue(), 4).alias("revenue"))


def unit_price_trend(lineitem):
    """Mean unit price per part and month; unit prices are summed as exact decimals."""
    price = (F.col("l_extendedprice") / F.col("l_quantity")).cast("decimal(18,8)")
    return lineitem.groupBy("l_partkey", F.date_trunc("month", "l_shipdate").alias("month")).agg(
        (F.sum(price).cast("double") / rows()).alias("unit_price")
    )


def monthly_orders(orders):
    return orders.groupBy(F.date_trunc("month", "o_orderdate").alias("month")).agg(
        rows().alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("revenue")
    )


def orders_by_status(orders):
    return orders.groupBy("o_orderstatus").agg(rows().alias("count"))


def revenue_share_by_method(orders):
    groups = orders.groupBy("o_orderpriority").agg(F.sum("o_totalprice").alias("_r"))
    return share_of_all(groups, "_r").drop("_r")


def completed_total(orders, start, end):
    return orders.where((F.col("o_orderstatus") == "F") & between("o_orderdate", start, end)).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total")
    )


def payment_share(lineitem):
    groups = lineitem.groupBy("l_returnflag").agg(revenue().alias("_r"))
    return share_of_all(groups, "_r").drop("_r")


def failure_causes(events):
    return events.groupBy(F.get_json_object("props", "$.k").alias("cause")).agg(
        F.count_if(F.col("event_type") == "error").alias("failures"), rows().alias("attempts")
    )


# --- products ---------------------------------------------------------------------


def price_comparison(part):
    plain = part.groupBy("p_type").agg(
        F.min("p_retailprice").alias("min_price"),
        F.round(F.avg("p_retailprice"), 6).alias("avg_price"),
        F.max("p_retailprice").alias("max_price"),
    )
    median = exact_percentiles(part, ["p_type"], "p_retailprice", [0.5])
    return null_safe_join(plain, median.select("p_type", F.round("p0", 6).alias("median_price")), ["p_type"], "left")


def popular_by_brand(part, lineitem, k: int = 3):
    sold = lineitem.groupBy("l_partkey").agg(F.sum("l_quantity").alias("units"))
    joined = part.select("p_partkey", "p_brand").join(sold, F.col("p_partkey") == F.col("l_partkey"))
    return newest_per_key(joined, ["p_brand"], [F.desc("units"), F.col("p_partkey")], k, "rank").select(
        "p_brand", "p_partkey", "units", "rank"
    )


def stock_by_state(part, lineitem):
    sold = lineitem.groupBy("l_partkey", "l_linestatus").agg(F.sum("l_quantity").alias("q"))
    joined = sold.join(part.select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey"))
    pivoted = joined.groupBy("p_type").pivot("l_linestatus", ["F", "O"]).sum("q")
    return pivoted.select("p_type", F.col("F").alias("filled"), F.col("O").alias("open"))


# --- reviews ----------------------------------------------------------------------


def rating_per_product(documents, labels):
    rated = documents.select("doc_id", "source").join(labels, "doc_id")
    return rated.groupBy("source").agg(
        F.round(F.avg("quality"), 6).alias("rating"), rows().alias("reviews")
    )


def verified_reviews(documents, labels):
    return documents.select("doc_id", "lang", "source").join(labels.select("doc_id"), "doc_id", "left_semi")


def most_helpful(documents, k: int = 20):
    return documents.select("doc_id", "lang", "n_chars").orderBy(F.desc("n_chars"), "doc_id").limit(k)


# --- activity ---------------------------------------------------------------------


def activity_frequency(events, start, end):
    return (
        events.where(between("ts", start, end))
        .groupBy("user_id", "event_type")
        .agg(rows().alias("activities"))
    )


def activity_pivot(events, types: list[str]):
    """Activities per user, one column per type, from one aggregate."""
    return events.groupBy("user_id").agg(*[F.count_if(F.col("event_type") == x).alias(x) for x in types])


def popular_products(events, k: int = 10):
    return (
        events.groupBy(F.get_json_object("props", "$.k").cast("bigint").alias("product"))
        .agg(rows().alias("activities"))
        .orderBy(F.desc("activities"), "product")
        .limit(k)
    )


def session_steps(events, gap_minutes: int = 30):
    """Every event with the start of its session and the step before it.

    A session ends after a pause longer than the gap. Works per user and time
    bucket and carries the open session on, so no user is held in one task.
    """
    steps, bucket, order = bucketed(
        events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"]
    )
    gap = F.make_dt_interval(mins=F.lit(gap_minutes))
    placed = sessions_in_buckets(steps, ["user_id"], order, gap, bucket, {"event_type": "previous_type"})
    return placed.select("user_id", "session_start", "ts", "event_id", "event_type", "previous_type")


def session_summary(events, gap_minutes: int = 30):
    return session_steps(events, gap_minutes).groupBy("user_id", "session_start").agg(
        F.max("ts").alias("session_end"),
        rows().alias("steps"),
        F.min_by("event_type", F.struct("ts", "event_id")).alias("entry_type"),
        F.max_by("event_type", F.struct("ts", "event_id")).alias("exit_type"),
    )


def session_transitions(events, gap_minutes: int = 30):
    return (
        session_steps(events, gap_minutes)
        .where(F.col("previous_type").isNotNull())
        .groupBy("previous_type", "event_type")
        .agg(rows().alias("transitions"))
    )


# --- users ------------------------------------------------------------------------


def latest_order(orders):
    newest = F.max_by(F.struct("o_orderkey", "o_orderdate", "o_totalprice"), F.struct("o_orderdate", "o_orderkey"))
    return orders.groupBy("o_custkey").agg(newest.alias("_o")).select("o_custkey", "_o.*")


def address_distribution(customer, nation, region):
    per_nation = customer.groupBy("c_nationkey").agg(rows().alias("customers"))
    placed = (
        per_nation.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .select("r_name", "n_name", "customers")
    )
    return share_of_all(placed, "customers")


def change_history(events):
    """Events whose type differs from the one before of the same user."""
    steps, bucket, order = bucketed(
        events.select("user_id", "event_id", "ts", "event_type"), ["user_id"], ["ts", "event_id"]
    )
    lagged = lag_in_buckets(steps, ["user_id"], order, bucket, {"event_type": "previous_type"})
    return lagged.where(F.col("previous_type") != F.col("event_type"))


def user_counts(customer, orders, since):
    recent = orders.where(F.col("o_orderdate") >= ntz(since)).select(F.col("o_custkey").alias("c_custkey"))
    active = customer.join(recent, "c_custkey", "left_semi").agg(rows()).scalar()
    return customer.agg(rows().alias("users")).withColumn("active_users", active)


def signup_trend(events, days: int = 7):
    """Signups per day with a moving mean; the window sees one row per day."""
    daily = (
        events.where(F.col("event_type") == "signup")
        .groupBy("event_type", F.to_date("ts").alias("day"))
        .agg(rows().alias("signups"))
    )
    w = Window.partitionBy("event_type").orderBy("day").rowsBetween(-(days - 1), 0)
    return daily.select("day", "signups", F.round(F.avg("signups").over(w), 6).alias("moving_mean"))


def users_in_state(customer):
    return customer.where(F.col("c_acctbal") < 0).select("c_custkey", "c_name", "c_acctbal")


# --- example questions --------------------------------------------------------------


def signups_on(events, day: str):
    return events.where((F.col("event_type") == "signup") & on_day(F.col("ts"), day)).agg(
        rows().alias("signups")
    )


def recent_orders(events, now: str, minutes: int = 60):
    cutoff = ntz(now) - F.make_dt_interval(mins=F.lit(minutes))
    recent = (F.col("ts") >= cutoff) & (F.col("ts") < ntz(now))
    return events.where((F.col("event_type") == "purchase") & recent).agg(rows().alias("orders"))


def mean_response(events):
    return events.where(F.col("event_type") == "view").agg(F.round(F.avg("value"), 6).alias("mean_value"))


def error_count(events):
    return events.agg(F.count_if(F.col("event_type") == "error").alias("errors"))
