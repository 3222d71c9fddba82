"""Business metric workload (M) with SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.fixtures import NOW, TODAY
from vigilframe.plans import workload as W
from vigilframe.suite.base import query

REV = "l_extendedprice * (1 - l_discount)"
Y97, Y98 = "1997-01-01 00:00:00", "1998-01-01 00:00:00"
TYPES = ["click", "error", "purchase", "signup", "view"]


@query("m01_active_categories", "SELECT DISTINCT p_type FROM {part} WHERE p_size > 0")
def _(t):
    return W.active_categories(t.part)


@query(
    "m02_category_structure",
    """SELECT r_name, count(n_name) AS children, string_agg(n_name, ',' ORDER BY n_name) AS child_names
       FROM {region} LEFT JOIN {nation} ON r_regionkey = n_regionkey GROUP BY r_name""",
)
def _(t):
    return W.category_structure(t.region, t.nation)


_NODES = """
    SELECT 'r' || CAST(r_regionkey AS STRING) AS id, CAST(NULL AS STRING) AS parent_id, r_name AS name
    FROM {region}
    UNION ALL SELECT 'n' || CAST(n_nationkey AS STRING), 'r' || CAST(n_regionkey AS STRING), n_name FROM {nation}
    UNION ALL SELECT 's' || CAST(s_suppkey AS STRING), CASE WHEN s_suppkey % 9 = 8 THEN 'gone'
      WHEN s_suppkey % 9 = 7 THEN 's' || CAST(s_suppkey AS STRING) ELSE 'n' || CAST(s_nationkey AS STRING) END,
      s_name FROM {supplier}"""


@query(
    "m02_hierarchy_paths",
    f"""WITH RECURSIVE nodes AS ({_NODES}), tree(id, depth, path) AS (
          SELECT id, 0, name FROM nodes WHERE parent_id IS NULL
          UNION ALL SELECT n.id, t.depth + 1, t.path || '/' || n.name
          FROM nodes n JOIN tree t ON n.parent_id = t.id)
        SELECT n.id, t.depth, t.path FROM nodes n LEFT JOIN tree t ON n.id = t.id""",
)
def _(t):
    return W.hierarchy(t.sql(_NODES))


@query(
    "m03_products_per_category",
    """SELECT p_type, count(*) AS products, min(p_size) AS min_size, max(p_size) AS max_size
       FROM {part} GROUP BY 1""",
)
def _(t):
    return W.products_per_category(t.part)


_STOCK = """SELECT l_partkey, sum(l_quantity) AS quantity,
    sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END) AS reserved FROM {lineitem} GROUP BY 1"""


@query("m04_stock", _STOCK)
def _(t):
    return W.stock(t.lineitem)


@query("m05_reorder_needed", f"SELECT l_partkey, reserved FROM ({_STOCK}) WHERE reserved <= 300")
def _(t):
    return W.reorder_needed(t.lineitem, 300.0)


@query(
    "m06_warehouse_distribution",
    """SELECT l_suppkey, quantity, round(quantity * 100.0E0 / (SELECT sum(l_quantity) FROM {lineitem}), 4)
       AS share_pct FROM (SELECT l_suppkey, sum(l_quantity) AS quantity FROM {lineitem} GROUP BY 1)""",
)
def _(t):
    return W.warehouse_distribution(t.lineitem)


@query(
    "m07_units_sold",
    f"""SELECT l_partkey, sum(l_quantity) AS units FROM {{lineitem}}
        WHERE l_shipdate >= TIMESTAMP '{Y97}' AND l_shipdate < TIMESTAMP '{Y98}' GROUP BY 1""",
)
def _(t):
    return W.units_sold(t.lineitem, Y97, Y98)


@query("m08_order_revenue", f"SELECT l_orderkey, round(sum({REV}), 4) AS revenue FROM {{lineitem}} GROUP BY 1")
def _(t):
    return W.order_revenue(t.lineitem)


@query(
    "m09_unit_price_trend",
    """SELECT l_partkey, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS month,
         CAST(sum(CAST(l_extendedprice / l_quantity AS DECIMAL(18, 8))) AS DOUBLE) / count(*) AS unit_price FROM {lineitem} GROUP BY 1, 2""",
)
def _(t):
    return W.unit_price_trend(t.lineitem).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query(
    "m10_monthly_orders",
    """SELECT CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS month, count(*) AS orders,
         round(sum(o_totalprice), 2) AS revenue FROM {orders} GROUP BY 1""",
)
def _(t):
    return W.monthly_orders(t.orders).withColumn("month", F.col("month").cast("timestamp_ntz"))


@query("m11_orders_by_status", 'SELECT o_orderstatus, count(*) AS "count" FROM {orders} GROUP BY 1')
def _(t):
    return W.orders_by_status(t.orders)


@query(
    "m12_revenue_share_by_method",
    """SELECT o_orderpriority, round(sum(o_totalprice) * 100.0E0 / (SELECT sum(o_totalprice) FROM {orders}), 4)
       AS share_pct FROM {orders} GROUP BY 1""",
)
def _(t):
    return W.revenue_share_by_method(t.orders)


@query(
    "m13_completed_total",
    f"""SELECT round(sum(o_totalprice), 2) AS total FROM {{orders}} WHERE o_orderstatus = 'F'
        AND o_orderdate >= TIMESTAMP '{Y97}' AND o_orderdate < TIMESTAMP '{Y98}'""",
)
def _(t):
    return W.completed_total(t.orders, Y97, Y98)


@query(
    "m14_payment_share",
    f"""SELECT l_returnflag, round(sum({REV}) * 100.0E0 / (SELECT sum({REV}) FROM {{lineitem}}), 4) AS share_pct
        FROM {{lineitem}} GROUP BY 1""",
)
def _(t):
    return W.payment_share(t.lineitem)


@query(
    "m15_failure_causes",
    """SELECT json_extract_string(props, '$.k') AS cause, count(*) FILTER (WHERE event_type = 'error')
         AS failures, count(*) AS attempts FROM {events} GROUP BY 1""",
)
def _(t):
    return W.failure_causes(t.events)


@query(
    "m16_price_comparison",
    """SELECT p_type, min(p_retailprice) AS min_price, round(avg(p_retailprice), 6) AS avg_price,
         max(p_retailprice) AS max_price, round(quantile_cont(p_retailprice, 0.5), 6) AS median_price
       FROM {part} GROUP BY 1""",
)
def _(t):
    return W.price_comparison(t.part)


@query(
    "m17_popular_by_brand",
    """SELECT p_brand, p_partkey, units, CAST(rn AS INT) AS rank FROM (
         SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY units DESC, p_partkey) AS rn FROM (
           SELECT p_brand, p_partkey, sum(l_quantity) AS units
           FROM {part} JOIN {lineitem} ON p_partkey = l_partkey GROUP BY 1, 2)) WHERE rn <= 3""",
)
def _(t):
    return W.popular_by_brand(t.part, t.lineitem)


@query(
    "m18_stock_by_state",
    """SELECT p_type, sum(l_quantity) FILTER (WHERE l_linestatus = 'F') AS filled,
         sum(l_quantity) FILTER (WHERE l_linestatus = 'O') AS open
       FROM {part} JOIN {lineitem} ON p_partkey = l_partkey GROUP BY 1""",
)
def _(t):
    return W.stock_by_state(t.part, t.lineitem)


@query(
    "m19_rating_per_product",
    """SELECT source, round(avg(quality), 6) AS rating, count(*) AS reviews
       FROM {documents} JOIN {labels} USING (doc_id) GROUP BY 1""",
)
def _(t):
    return W.rating_per_product(t.documents, t.labels)


@query(
    "m20_verified_reviews",
    "SELECT doc_id, lang, source FROM {documents} WHERE doc_id IN (SELECT doc_id FROM {labels})",
)
def _(t):
    return W.verified_reviews(t.documents, t.labels)


@query("m21_most_helpful", "SELECT doc_id, lang, n_chars FROM {documents} ORDER BY n_chars DESC, doc_id LIMIT 20")
def _(t):
    return W.most_helpful(t.documents)


@query(
    "m22_activity_frequency",
    """SELECT user_id, event_type, count(*) AS activities FROM {events}
       WHERE ts >= TIMESTAMP '2024-01-08 00:00:00' AND ts < TIMESTAMP '2024-01-22 00:00:00' GROUP BY 1, 2""",
)
def _(t):
    return W.activity_frequency(t.events, "2024-01-08 00:00:00", "2024-01-22 00:00:00")


@query(
    "m22_activity_pivot",
    "SELECT user_id, "
    + ", ".join(f"count(*) FILTER (WHERE event_type = '{x}') AS {x}" for x in TYPES)
    + " FROM {events} GROUP BY 1",
)
def _(t):
    return W.activity_pivot(t.events, TYPES)


@query(
    "m23_popular_products",
    """SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS product, count(*) AS activities
       FROM {events} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10""",
)
def _(t):
    return W.popular_products(t.events)


STEPS = """(SELECT user_id, max(ts) FILTER (WHERE is_start) OVER w AS session_start, ts, event_id, event_type,
        CASE WHEN NOT is_start THEN prev_type END AS previous_type
      FROM (SELECT *, prev_ts IS NULL OR ts - prev_ts > INTERVAL '30' MINUTE AS is_start
        FROM (SELECT *, lag(ts) OVER o AS prev_ts, lag(event_type) OVER o AS prev_type FROM {events}
              WINDOW o AS (PARTITION BY user_id ORDER BY ts, event_id)))
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))"""


@query("m24_session_steps", f"SELECT * FROM {STEPS}")
def _(t):
    return W.session_steps(t.events)


@query(
    "m24_session_summary",
    f"""SELECT user_id, session_start, max(ts) AS session_end, count(*) AS steps,
          min_by(event_type, (ts, event_id)) AS entry_type, max_by(event_type, (ts, event_id)) AS exit_type
        FROM {STEPS} GROUP BY 1, 2""",
)
def _(t):
    return W.session_summary(t.events)


@query(
    "m24_session_transitions",
    f"""SELECT previous_type, event_type, count(*) AS transitions FROM {STEPS}
        WHERE previous_type IS NOT NULL GROUP BY 1, 2""",
)
def _(t):
    return W.session_transitions(t.events)


@query(
    "m25_latest_order",
    """SELECT o_custkey, o_orderkey, o_orderdate, o_totalprice FROM (SELECT *, row_number() OVER (
         PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM {orders}) WHERE rn = 1""",
)
def _(t):
    return W.latest_order(t.orders)


@query(
    "m26_address_distribution",
    """SELECT r_name, n_name, count(*) AS customers,
         round(count(*) * 100.0E0 / (SELECT count(*) FROM {customer}), 4) AS share_pct
       FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
       GROUP BY 1, 2""",
)
def _(t):
    return W.address_distribution(t.customer, t.nation, t.region)


@query(
    "m27_change_history",
    """SELECT user_id, event_id, ts, event_type, previous_type FROM (SELECT *, lag(event_type) OVER (
         PARTITION BY user_id ORDER BY ts, event_id) AS previous_type FROM {events})
       WHERE previous_type <> event_type""",
)
def _(t):
    return W.change_history(t.events)


@query(
    "m28_user_counts",
    """SELECT count(*) AS users, (SELECT count(*) FROM {customer} WHERE c_custkey IN (SELECT o_custkey FROM {orders}
         WHERE o_orderdate >= TIMESTAMP '2001-01-01 00:00:00')) AS active_users FROM {customer}""",
)
def _(t):
    return W.user_counts(t.customer, t.orders, "2001-01-01 00:00:00")


@query(
    "m29_signup_trend",
    """SELECT day, signups, round(avg(signups) OVER (ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW), 6)
         AS moving_mean FROM (SELECT CAST(ts AS DATE) AS day, count(*) AS signups FROM {events}
         WHERE event_type = 'signup' GROUP BY 1)""",
)
def _(t):
    return W.signup_trend(t.events)


@query("m30_users_in_state", "SELECT c_custkey, c_name, c_acctbal FROM {customer} WHERE c_acctbal < 0")
def _(t):
    return W.users_in_state(t.customer)


@query(
    "m31_signups_today",
    f"""SELECT count(*) AS signups FROM {{events}} WHERE event_type = 'signup'
        AND CAST(ts AS DATE) = DATE '{TODAY}'""",
)
def _(t):
    return W.signups_on(t.events, TODAY)


@query(
    "m32_orders_last_hour",
    f"""SELECT count(*) AS orders FROM {{events}} WHERE event_type = 'purchase'
        AND ts >= TIMESTAMP '{NOW}' - INTERVAL '60' MINUTE AND ts < TIMESTAMP '{NOW}'""",
)
def _(t):
    return W.recent_orders(t.events, NOW)


@query("m33_mean_response", "SELECT round(avg(value), 6) AS mean_value FROM {events} WHERE event_type = 'view'")
def _(t):
    return W.mean_response(t.events)


@query("m34_error_count", "SELECT count(*) FILTER (WHERE event_type = 'error') AS errors FROM {events}")
def _(t):
    return W.error_count(t.events)
