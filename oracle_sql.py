"""DuckDB SQL for every registered query that SQL can express.

The texts are written from the meaning of each query, over the sample tables mapped to
the shop model by the common table expressions below.
"""

from __future__ import annotations

TABLES = """
shop_customers AS (
  SELECT c_custkey AS customer_id, c_custkey // 2 AS customer_unique_id,
         c_nationkey AS customer_zip_code_prefix, c_mktsegment AS customer_city, n_name AS customer_state
  FROM customer JOIN nation ON c_nationkey = n_nationkey
),
shop_sellers AS (
  SELECT s_suppkey AS seller_id, s_nationkey AS seller_zip_code_prefix, s_name AS seller_city,
         n_name AS seller_state
  FROM supplier JOIN nation ON s_nationkey = n_nationkey
),
shop_orders AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id,
         CASE WHEN o_orderstatus = 'F' THEN 'delivered' WHEN o_orderstatus = 'P' THEN 'canceled'
              WHEN o_orderpriority = '1-URGENT' THEN 'processing' ELSE 'shipped' END AS order_status,
         o_orderdate AS purchased,
         o_orderdate + to_days(CAST(o_orderkey % 3 AS INT)) AS approved,
         s.carrier, s.arrived,
         o_orderdate + to_days(CAST(20 + o_orderkey % 20 AS INT)) AS estimated
  FROM orders LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS carrier, max(l_shipdate) AS arrived
                         FROM lineitem GROUP BY l_orderkey) s ON o_orderkey = s.l_orderkey
),
shop_items AS (
  SELECT CAST(l_linenumber AS BIGINT) AS order_item_id, l_orderkey AS order_id, l_partkey AS product_id,
         l_suppkey AS seller_id, l_shipdate AS shipping_limit_date, CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(l_tax * 100 AS DECIMAL(10,2)) AS freight_value
  FROM lineitem
),
shop_products AS (
  SELECT p_partkey AS product_id, p_brand AS product_category_name,
         CASE WHEN p_brand <> 'Brand#1' THEN p_brand END AS product_category_name_english
  FROM part
),
shop_payments AS (
  SELECT o_orderkey AS payment_id, o_orderkey AS order_id, o_orderpriority AS payment_type,
         CAST(o_totalprice AS DECIMAL(10,2)) AS payment_value
  FROM orders
),
shop_reviews AS (
  SELECT o_orderkey * 2 AS review_id, o_orderkey AS order_id, CAST(o_orderkey % 5 + 1 AS INT) AS review_score,
         o_orderdate + to_days(10) AS written,
         o_orderdate + to_days(CAST(10 + o_orderkey % 7 AS INT)) AS answered
  FROM orders WHERE o_orderpriority <> '5-LOW'
  UNION ALL
  SELECT o_orderkey * 2 + 1, o_orderkey, 1, o_orderdate + to_days(10),
         o_orderdate + to_days(CAST(10 + o_orderkey % 7 AS INT))
  FROM orders WHERE o_orderpriority = '1-URGENT'
),
shop_places AS (
  SELECT n_nationkey AS geolocation_zip_code_prefix, CAST(n_regionkey AS DOUBLE) AS geolocation_lat,
         CAST(n_nationkey AS DOUBLE) AS geolocation_lng, r_name AS geolocation_city, n_name AS geolocation_state
  FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'AFRICA'
),
sold AS (
  SELECT i.*, o.customer_id, o.order_status, o.purchased, c.customer_unique_id, c.customer_state,
         price + freight_value AS rev
  FROM shop_items i JOIN shop_orders o USING (order_id) JOIN shop_customers c USING (customer_id)
),
placed AS (
  SELECT o.*, c.customer_unique_id, c.customer_state
  FROM shop_orders o JOIN shop_customers c USING (customer_id)
)
"""

START, END = "TIMESTAMP '1996-01-01 00:00:00'", "TIMESTAMP '2000-12-31 23:59:59.999999'"
PERIOD = f"purchased BETWEEN {START} AND {END}"
DELIVERED = f"order_status = 'delivered' AND {PERIOD}"
EVENTS = "ts BETWEEN TIMESTAMP '2024-01-01 00:00:00' AND TIMESTAMP '2024-12-31 23:59:59.999999'"


def over_shop(sql: str, *extra: str) -> str:
    """Prefix the shop tables and further named subqueries to a SELECT."""
    return "WITH " + ", ".join([TABLES, *extra]) + sql


def money(expression: str) -> str:
    return f"CAST({expression} AS DOUBLE)"


def per(top: str, bottom: str) -> str:
    return f"CAST({top} AS DOUBLE) / nullif(CAST({bottom} AS DOUBLE), 0)"


def pct(part: str, whole: str) -> str:
    return f"CAST({part} AS DOUBLE) * CAST(100 AS DOUBLE) / nullif(CAST({whole} AS DOUBLE), 0)"


def days(first: str, last: str) -> str:
    """Mean days from exact microseconds."""
    micros = f"epoch_us({last}) - epoch_us({first})"
    return f"CAST(sum({micros}) AS DOUBLE) / 1000000 / nullif(count({micros}), 0) / CAST(86400 AS DOUBLE)"


def kpis(first: str, last: str) -> str:
    return f"""
      SELECT count(DISTINCT order_id) AS total_orders, {money('sum(rev)')} AS total_revenue,
             {per('sum(rev)', 'count(DISTINCT order_id)')} AS avg_order_value,
             count(DISTINCT customer_unique_id) AS active_customers,
             (SELECT count(DISTINCT customer_unique_id) FROM
                (SELECT customer_unique_id, row_number() OVER (PARTITION BY customer_unique_id ORDER BY purchased) AS seq
                 FROM sold WHERE order_status = 'delivered' AND purchased BETWEEN {first} AND {last})
              WHERE seq = 1) AS new_customers
      FROM sold WHERE order_status = 'delivered' AND purchased BETWEEN {first} AND {last}"""


def _against_previous() -> str:
    names = ("total_orders", "total_revenue", "avg_order_value", "active_customers", "new_customers")
    now = ", ".join(f"n.{k} AS {k}" for k in names)
    before = ", ".join(f"p.{k} AS previous_{k}" for k in names)
    delta = ", ".join(f"n.{k} - p.{k} AS delta_{k}" for k in names)
    earlier = f"{START} - ({END} - {START})", f"{START} - INTERVAL 1 SECOND"
    return over_shop(
        f"SELECT {now}, {before}, {delta} FROM now_kpis n, before_kpis p",
        f"now_kpis AS ({kpis(START, END)})",
        f"before_kpis AS ({kpis(*earlier)})",
    )


def trend(unit: str, columns: str, where: str = DELIVERED, source: str = "sold") -> str:
    return over_shop(
        f"SELECT date_trunc('{unit}', purchased)::TIMESTAMP AS time_period, {columns} FROM {source} WHERE {where} GROUP BY 1"
    )


def revenue_trend(unit: str) -> str:
    return trend(unit, f"{money('sum(rev)')} AS total_revenue, count(DISTINCT order_id) AS total_orders")


MATRIX = f"""matrix AS (
  SELECT p.product_category_name_english, {money('sum(s.rev)')} AS total_revenue,
         count(DISTINCT s.order_item_id) AS total_units_sold,
         coalesce({per('sum(r.review_score)', 'count(r.review_score)')}, 0) AS avg_review_score
  FROM (SELECT * FROM sold WHERE {DELIVERED}) s JOIN shop_products p USING (product_id)
  LEFT JOIN shop_reviews r ON r.order_id = s.order_id
  WHERE p.product_category_name_english IS NOT NULL GROUP BY 1)"""
RETURNS = f"""returned AS (
  SELECT product_category_name_english,
         {pct("count(CASE WHEN order_status = 'canceled' THEN order_id END)", 'count(order_id)')}
           AS return_rate_percentage
  FROM sold JOIN shop_products USING (product_id)
  WHERE {PERIOD} AND product_category_name_english IS NOT NULL GROUP BY 1)"""
MERGED = """merged AS (
  SELECT m.*, coalesce(r.return_rate_percentage, 0) AS return_rate_percentage
  FROM matrix m LEFT JOIN returned r USING (product_category_name_english))"""


def over_matrix(sql: str) -> str:
    return over_shop(sql, MATRIX, RETURNS, MERGED)


def ranking(measure: str, n: int) -> str:
    top = f"""SELECT product_category_name_english, CAST({measure} AS DOUBLE) AS value, 'top' AS side FROM merged
              ORDER BY {measure} DESC, product_category_name_english LIMIT {n}"""
    tail = f"""SELECT product_category_name_english, CAST({measure} AS DOUBLE) AS value, 'bottom' AS side FROM merged
               ORDER BY {measure}, product_category_name_english DESC LIMIT {n}"""
    return over_matrix(f"SELECT * FROM ({top}) UNION ALL SELECT * FROM ({tail})")


SPEND = f"""spend AS (
  SELECT customer_unique_id, {money('sum(rev)')} AS total_spent FROM sold WHERE {DELIVERED} GROUP BY 1)"""
COUNTS = f"""counts AS (
  SELECT customer_unique_id, count(DISTINCT order_id) AS n FROM placed WHERE {DELIVERED} GROUP BY 1)"""
PEAKS = f"""peaks AS (
  SELECT CAST(extract(dow FROM ts) AS BIGINT) AS day_of_week, CAST(extract(hour FROM ts) AS BIGINT) AS hour_of_day,
         count(event_id) AS total_orders
  FROM events WHERE {EVENTS} GROUP BY 1, 2)"""
PAID = f"""paid AS (
  SELECT p.payment_type, count(*) AS usage_count FROM shop_payments p JOIN shop_orders o USING (order_id)
  WHERE {PERIOD} GROUP BY 1)"""
SHIPPING = f"""shipping AS (
  SELECT customer_state, {days('purchased', 'arrived')} AS avg_actual_delivery_time_days,
         {days('purchased', 'estimated')} AS avg_estimated_delivery_time_days, count(order_id) AS num_orders_to_state
  FROM placed WHERE {DELIVERED} AND arrived IS NOT NULL AND estimated IS NOT NULL GROUP BY 1)"""
BREAKDOWN = f"""breakdown AS (
  SELECT customer_state, {days('purchased', 'approved')} AS avg_payment_processing_time,
         {days('approved', 'carrier')} AS avg_seller_handling_time,
         {days('carrier', 'arrived')} AS avg_carrier_shipping_time
  FROM placed WHERE {DELIVERED} AND approved IS NOT NULL AND carrier IS NOT NULL AND arrived IS NOT NULL
    AND customer_state IN (SELECT customer_state FROM placed WHERE {DELIVERED} GROUP BY 1
                           ORDER BY count(order_id) DESC, customer_state LIMIT 5)
  GROUP BY 1)"""


def favourites(people: str) -> str:
    return over_shop(f"""
      SELECT product_category_name_english, count(DISTINCT order_id) AS total_orders_for_category,
             {money('sum(rev)')} AS total_revenue_for_category
      FROM sold JOIN shop_products USING (product_id)
      WHERE {DELIVERED} AND product_category_name_english IS NOT NULL AND {people}
      GROUP BY 1 ORDER BY sum(rev) DESC, 1 LIMIT 10""")


REPEAT = f"""customer_unique_id IN (
  SELECT customer_unique_id FROM placed WHERE order_status = 'delivered' AND purchased <= {END}
  GROUP BY 1 HAVING count(DISTINCT order_id) > 1)"""
FIRST_TIME = f"""customer_unique_id NOT IN (
  SELECT customer_unique_id FROM placed WHERE order_status = 'delivered' AND purchased < {START} GROUP BY 1)
  AND customer_unique_id IN (
  SELECT customer_unique_id FROM placed WHERE order_status = 'delivered' GROUP BY 1
  HAVING min(purchased) BETWEEN {START} AND {END})"""

NEWEST = "(SELECT max(purchased) FROM shop_orders)"


def gaps(where: str, default: int) -> str:
    return f"""SELECT customer_unique_id,
        coalesce({per('sum(gap)', 'count(gap)')}, {default}) AS avg_days_between_orders
      FROM (SELECT customer_unique_id, extract(day FROM lead(purchased) OVER
              (PARTITION BY customer_unique_id ORDER BY purchased) - purchased) AS gap
            FROM placed WHERE {where}) GROUP BY 1"""


ORDER_VALUES = """order_values AS (
  SELECT order_id, CAST(sum(price * order_item_id) + sum(freight_value * order_item_id) AS DOUBLE) AS total_order_value
  FROM shop_items GROUP BY 1)"""
PAIRS = """pairs AS (
  SELECT customer_unique_id, product_id, count(*) AS total_purchases
  FROM sold WHERE order_status = 'delivered' GROUP BY 1, 2)"""
CATEGORIES = """categories AS (
  SELECT customer_unique_id, product_category_name AS category, CAST(sum(total_purchases) AS BIGINT) AS total_purchases
  FROM pairs JOIN shop_products USING (product_id) GROUP BY 1, 2)"""

UPDATED = f"""
item_part AS (
  SELECT customer_unique_id, {money('sum(rev)')} AS clv, {per('sum(rev)', 'count(rev)')} AS avg_order_value,
         {per('sum(freight_value)', 'count(freight_value)')} AS avg_shipping_cost
  FROM sold WHERE order_status = 'delivered' GROUP BY 1),
order_part AS (
  SELECT customer_unique_id, CAST(count(order_id) AS INTEGER) AS total_orders
  FROM placed WHERE order_status = 'delivered' GROUP BY 1),
gap_part AS ({gaps("order_status = 'delivered'", 0)}),
return_part AS (
  SELECT customer_unique_id, {pct("count(CASE WHEN order_status = 'canceled' THEN 1 END)", 'count(order_id)')}
    AS estimated_return_rate FROM placed GROUP BY 1),
updated AS (
  SELECT c.*, clv, avg_days_between_orders, total_orders, avg_order_value, avg_shipping_cost, estimated_return_rate
  FROM shop_customers c LEFT JOIN item_part USING (customer_unique_id) LEFT JOIN order_part USING (customer_unique_id)
  LEFT JOIN gap_part USING (customer_unique_id) LEFT JOIN return_part USING (customer_unique_id))"""


def updated(columns: str) -> str:
    return over_shop(f"SELECT {columns} FROM updated", UPDATED)


def series(unit: str) -> str:
    return f"""SELECT CAST(date_trunc('{unit}', purchased) AS DATE) AS ds,
        CAST(sum(w) AS DOUBLE) AS y
      FROM shop_orders LEFT JOIN (SELECT order_id, sum(price * order_item_id) + sum(freight_value * order_item_id) AS w
                                  FROM shop_items GROUP BY 1) USING (order_id)
      WHERE order_status = 'delivered' GROUP BY 1"""


def trimmed(unit: str) -> str:
    return over_shop(
        """SELECT ds, y FROM series, bounds
           WHERE ln(y) BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)""",
        f"series AS ({series(unit)})",
        "bounds AS (SELECT quantile_cont(ln(y), 0.25) AS q1, quantile_cont(ln(y), 0.75) AS q3 FROM series)",
    )


SPLIT = """split AS (
  SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) <= 6 AS is_test FROM state_series_all)"""
# Weeks in which a state only has orders without items still are steps, with no value.
STATE_SERIES_ALL = """state_series_all AS (
  SELECT customer_state AS series_id, CAST(date_trunc('week', purchased) AS DATE) AS ds, CAST(sum(w) AS DOUBLE) AS y
  FROM placed LEFT JOIN (SELECT order_id, sum(price * order_item_id) + sum(freight_value * order_item_id) AS w
                         FROM shop_items GROUP BY 1) USING (order_id)
  WHERE order_status = 'delivered' GROUP BY 1, 2)"""

# Segments by number of orders: a rule both sides can apply.
RULE = "CASE WHEN total_orders < 5 THEN 0 WHEN total_orders < 9 THEN 1 ELSE 2 END"
POINTS = f"""points AS (
  SELECT {RULE} AS segment, clv AS a, avg_shipping_cost AS b, customer_unique_id, avg_order_value, total_orders
  FROM updated WHERE clv IS NOT NULL AND total_orders IS NOT NULL)"""
CENTRES = "centres AS (SELECT segment, count(*) AS n, avg(a) AS ca, avg(b) AS cb FROM points GROUP BY 1)"

SPREAD = """spread AS (SELECT segment, ca, cb, avg(sqrt(pow(a - ca, 2) + pow(b - cb, 2))) AS s
                    FROM points JOIN centres USING (segment) GROUP BY 1, 2, 3)"""


def silhouettes(distance: str) -> str:
    """Mean silhouette of all points, pair by pair."""
    return f"""numbered AS (SELECT *, row_number() OVER () AS p FROM points),
      apart AS (SELECT x.p, x.segment, y.segment AS other, sum({distance}) AS total FROM numbered x, numbered y GROUP BY 1, 2, 3),
      widths AS (
        SELECT p, max(CASE WHEN segment = other THEN total / nullif(n - 1, 0) END) AS inside,
               min(CASE WHEN segment <> other THEN total / n END) AS outside
        FROM apart JOIN (SELECT segment AS other, n FROM centres) USING (other) GROUP BY 1),
      silhouettes AS (
        SELECT avg(coalesce((outside - inside) / nullif(greatest(outside, inside), 0), 0)) AS silhouette, count(*) AS rows,
               (SELECT count(*) FROM centres) AS segments FROM widths)"""


def _steps() -> str:
    return " UNION ALL ".join(
        f"""SELECT '{name}' AS frequency, CAST(date_trunc('{unit}', purchased) AS DATE) AS ds, customer_state AS state,
                   product_category_name_english AS category, (price + freight_value) * order_item_id AS w
            FROM shop_items JOIN shop_orders USING (order_id) LEFT JOIN shop_customers USING (customer_id)
            LEFT JOIN shop_products USING (product_id) WHERE order_status = 'delivered'"""
        for name, unit in (("quarterly", "quarter"), ("weekly", "week"), ("daily", "day"))
    )


LEVELS = f"""steps AS ({_steps()}),
levels AS (
  SELECT frequency, CASE grouping(state, category) WHEN 0 THEN 'state_category' WHEN 1 THEN 'state' WHEN 2 THEN 'category'
           ELSE 'shop' END AS level, state, category,
         frequency || CASE WHEN grouping(state) = 0 THEN '/state=' || coalesce(state, '?') ELSE '' END
           || CASE WHEN grouping(category) = 0 THEN '/category=' || coalesce(category, '?') ELSE '' END AS series_id,
         ds, CAST(sum(w) AS DOUBLE) AS y
  FROM steps GROUP BY GROUPING SETS ((frequency, ds), (frequency, ds, state), (frequency, ds, category), (frequency, ds, state, category)))"""


def oracle() -> dict[str, str]:
    q: dict[str, str] = {}

    # Business health
    q["main_kpis"] = over_shop(kpis(START, END))
    q["kpis_against_previous"] = _against_previous()
    q["kpis_first_ever"] = over_shop(
        f"""SELECT count(DISTINCT order_id) AS total_orders, {money('sum(rev)')} AS total_revenue,
                   {per('sum(rev)', 'count(DISTINCT order_id)')} AS avg_order_value,
                   count(DISTINCT customer_unique_id) AS active_customers,
                   (SELECT count(*) FROM (SELECT min(purchased) AS first FROM sold
                      WHERE order_status = 'delivered' AND purchased <= {END} GROUP BY customer_unique_id) WHERE first >= {START})
                     AS new_customers
            FROM sold WHERE {DELIVERED}"""
    )
    q["gross_margin"] = over_shop(
        """SELECT r AS total_revenue, r * 0.6::DOUBLE AS cogs, r - r * 0.6::DOUBLE AS gross_profit,
                  coalesce((r - r * 0.6::DOUBLE) / nullif(r, 0) * 100::DOUBLE, 0) AS gross_margin_pct FROM total""",
        f"total AS (SELECT {money('sum(rev)')} AS r FROM sold WHERE {DELIVERED})",
    )
    q["new_customer_rate"] = over_shop(
        """SELECT new_customers, active_customers,
                  coalesce(new_customers::DOUBLE / nullif(active_customers, 0) * 100, 0) AS new_customer_rate_pct
           FROM k""",
        f"k AS ({kpis(START, END)})",
    )
    q["revenue_orders_trend_month"] = revenue_trend("month")
    q["revenue_orders_trend_year"] = revenue_trend("year")
    q["revenue_orders_trend_day"] = revenue_trend("day")
    q["aov_trend"] = trend("month", f"{per('sum(rev)', 'count(DISTINCT order_id)')} AS avg_order_value")
    q["new_vs_returning_revenue"] = over_shop(
        f"""SELECT date_trunc('month', purchased)::TIMESTAMP AS time_period,
              CAST(sum(CASE WHEN r = 1 THEN price + freight_value ELSE 0 END) AS DOUBLE) AS new_customer_revenue,
              CAST(sum(CASE WHEN r > 1 THEN price + freight_value ELSE 0 END) AS DOUBLE) AS returning_customer_revenue
            FROM ranked JOIN shop_items USING (order_id) WHERE {PERIOD} GROUP BY 1""",
        f"""ranked AS (SELECT order_id, purchased, row_number() OVER
              (PARTITION BY customer_unique_id ORDER BY purchased, order_id) AS r
            FROM placed WHERE order_status = 'delivered' AND purchased <= {END})""",
    )

    # Products
    q["category_performance"] = over_shop("SELECT * FROM matrix WHERE total_units_sold > 0", MATRIX)
    q["category_return_rates"] = over_shop("SELECT * FROM returned", RETURNS)
    q["category_matrix"] = over_matrix("SELECT * FROM merged")
    q["top_categories"] = over_matrix(
        " UNION ALL ".join(
            f"""SELECT * FROM (SELECT product_category_name_english, '{m}' AS measure, CAST({m} AS DOUBLE) AS value
                FROM merged ORDER BY {m} DESC, product_category_name_english LIMIT 1)"""
            for m in ("total_revenue", "total_units_sold", "return_rate_percentage")
        )
    )
    q["category_ranking_revenue"] = ranking("total_revenue", 10)
    q["category_ranking_units"] = ranking("total_units_sold", 10)
    q["top_return_rates"] = over_shop(
        "SELECT * FROM returned ORDER BY return_rate_percentage DESC, product_category_name_english LIMIT 15",
        RETURNS,
    )
    q["top_selling_products"] = over_shop(
        f"""SELECT product_id, product_category_name, count(order_id) AS total_sales, {money('sum(price)')} AS total_revenue
            FROM sold JOIN shop_products USING (product_id) WHERE {DELIVERED}
            GROUP BY 1, 2 ORDER BY total_sales DESC, product_id LIMIT 10"""
    )
    q["top_selling_categories"] = over_shop(
        """SELECT product_category_name_english AS category, count(product_id) AS total_sales
           FROM shop_items JOIN shop_products USING (product_id)
           GROUP BY 1 ORDER BY total_sales DESC, category NULLS LAST LIMIT 10"""
    )

    # Orders
    for unit in ("day", "week", "month", "quarter", "year"):
        q[f"orders_over_time_{unit}"] = trend(
            unit, "count(order_id) AS total_orders", source="shop_orders"
        )
    q["status_distribution"] = over_shop(
        f"SELECT order_status, count(order_id) AS total_orders FROM shop_orders WHERE {PERIOD} GROUP BY 1"
    )
    q["most_frequent_open_status"] = over_shop(
        f"""SELECT order_status, count(order_id) AS status_count FROM shop_orders
            WHERE order_status NOT IN ('delivered', 'canceled') AND {PERIOD}
            GROUP BY 1 ORDER BY status_count DESC, order_status LIMIT 1"""
    )
    q["revenue_by_basket_size"] = over_shop(
        f"""SELECT n AS items_per_order, {money('sum(r)')} AS total_revenue_from_order_size
            FROM (SELECT count(order_item_id) AS n, sum(rev) AS r FROM sold WHERE {DELIVERED} GROUP BY order_id)
            GROUP BY 1"""
    )
    q["average_items_per_order"] = over_shop(
        f"""SELECT {per('sum(n)', 'count(n)')} AS avg_items_per_order, count(order_id) AS total_orders_for_avg_items
            FROM (SELECT order_id, count(order_item_id) AS n FROM sold WHERE {DELIVERED} GROUP BY 1)"""
    )
    q["order_date_range"] = over_shop(
        "SELECT CAST(min(purchased) AS DATE) AS min_date, CAST(max(purchased) AS DATE) AS max_date FROM shop_orders"
    )
    q["peak_order_times"] = f"WITH {PEAKS} SELECT * FROM peaks"
    names = "['Sun', 'Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat']"
    q["peak_slot"] = f"""WITH {PEAKS} SELECT {names}[day_of_week + 1] AS day_name, hour_of_day, total_orders
                         FROM peaks ORDER BY total_orders DESC, day_of_week, hour_of_day LIMIT 1"""
    week = ("Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat")
    cells = ", ".join(
        f"CAST(coalesce(sum(total_orders) FILTER (day_of_week = {i}), 0) AS BIGINT) AS {d}" for i, d in enumerate(week)
    )
    q["order_heatmap"] = f"WITH {PEAKS} SELECT hour_of_day, {cells} FROM peaks GROUP BY 1"
    q["canceled_share_of_orders"] = over_shop(
        f"""SELECT {pct("count(CASE WHEN order_status = 'canceled' THEN 1 END)", 'count(*)')}
            AS estimated_return_rate FROM shop_orders"""
    )
    q["canceled_against_delivered"] = over_shop(
        f"""SELECT {pct('count(order_id)', "(SELECT count(order_id) FROM shop_orders WHERE order_status = 'delivered')")}
            AS estimated_return_rate FROM shop_orders WHERE order_status = 'canceled'"""
    )

    # Customers
    q["spend_per_person"] = over_shop("SELECT * FROM spend", SPEND)
    q["mean_spend"] = over_shop(
        "SELECT coalesce(CAST(sum(t) AS DOUBLE) / count(t), 0) AS avg_clv FROM s",
        f"s AS (SELECT sum(rev) AS t FROM sold WHERE {DELIVERED} GROUP BY customer_unique_id)",
    )
    q["spend_histogram"] = over_shop(
        """SELECT CAST(least(floor(coalesce((total_spent - lo) / nullif(hi - lo, 0) * 50, 0)) + 1, 50) AS BIGINT) AS bin,
                  count(*) AS customers
           FROM spend, (SELECT min(total_spent) AS lo, max(total_spent) AS hi FROM spend) GROUP BY 1""",
        SPEND,
    )
    q["repeat_customer_counts"] = over_shop(
        """SELECT count(customer_unique_id) AS total_customers_in_period,
                  count(CASE WHEN n > 1 THEN customer_unique_id END) AS repeat_customers_in_period FROM counts""",
        COUNTS,
    )
    q["repeat_rate"] = over_shop(
        """SELECT coalesce(count(CASE WHEN n > 1 THEN 1 END)::DOUBLE / nullif(count(*), 0) * 100, 0)
             AS repeat_rate_pct FROM counts""",
        COUNTS,
    )
    q["repeat_purchase_rate"] = over_shop(
        f"""SELECT {pct('count(CASE WHEN n > 1 THEN 1 END)', 'count(*)')} AS repeat_purchase_rate
            FROM (SELECT customer_unique_id, count(order_id) AS n FROM placed WHERE order_status = 'delivered' GROUP BY 1)"""
    )
    q["mean_days_between_orders"] = over_shop(
        f"""SELECT CAST(sum(gap) AS DOUBLE) / 1000000 / count(gap) / CAST(86400 AS DOUBLE) AS avg_days_between_orders
            FROM (SELECT epoch_us(purchased) - epoch_us(lag(purchased) OVER
                    (PARTITION BY customer_unique_id ORDER BY purchased)) AS gap FROM placed WHERE {DELIVERED})"""
    )
    q["top_categories_of_repeat"] = favourites(REPEAT)
    q["top_categories_of_first_time"] = favourites(FIRST_TIME)
    q["customer_rfm"] = over_shop(
        f"""SELECT customer_unique_id, max(purchased) AS last_purchase_date, count(order_id) AS purchase_frequency,
                   {money('sum(price)')} AS total_monetary_value
            FROM sold WHERE order_status = 'delivered' GROUP BY 1"""
    )
    q["lifetime_value"] = over_shop(
        f"""SELECT customer_unique_id, count(order_id) AS total_orders, {money('sum(price)')} AS total_revenue,
                   {per('sum(price)', 'count(order_id)')} AS avg_order_value
            FROM sold WHERE order_status = 'delivered' GROUP BY 1"""
    )
    q["churn_any_old_order"] = over_shop(
        f"""SELECT {pct(f"count(DISTINCT CASE WHEN purchased < {NEWEST} - INTERVAL 6 MONTH THEN customer_unique_id END)",
                        'count(DISTINCT customer_unique_id)')} AS churn_rate FROM placed"""
    )
    q["churn_last_delivered"] = over_shop(
        f"""SELECT {pct('count(DISTINCT customer_unique_id)',
                        '(SELECT count(DISTINCT customer_unique_id) FROM shop_customers)')} AS churn_rate
            FROM (SELECT customer_unique_id, max(purchased) AS last FROM placed WHERE order_status = 'delivered' GROUP BY 1)
            WHERE last < CAST({NEWEST} AS DATE) - INTERVAL 6 MONTH"""
    )

    # Payments and reviews
    q["payment_preferences"] = over_shop("SELECT * FROM paid", PAID)
    q["top_payment_type"] = over_shop(
        "SELECT payment_type FROM paid ORDER BY usage_count DESC, payment_type LIMIT 1", PAID
    )
    q["payment_shares"] = over_shop(
        f"SELECT *, {pct('usage_count', 'sum(usage_count) OVER ()')} AS share_pct FROM paid", PAID
    )
    performance = over_shop(
        f"""SELECT payment_type, count(*) AS total_transactions, {money('sum(payment_value)')} AS total_revenue
            FROM shop_payments GROUP BY 1"""
    )
    q["payment_method_performance"] = q["payment_performance"] = performance
    scores = over_shop(
        f"""SELECT review_score, count(*) AS review_count,
                   {pct('count(*)', '(SELECT count(*) FROM shop_reviews)')} AS percentage
            FROM shop_reviews GROUP BY 1"""
    )
    q["review_scores"] = q["customer_satisfaction"] = scores
    q["review_response_time"] = over_shop(
        f"""SELECT {per('sum(d)', 'count(d)')} AS avg_response_time
            FROM (SELECT extract(day FROM answered - written) AS d FROM shop_reviews)"""
    )
    shipping_cost = over_shop(
        f"SELECT {per('sum(freight_value)', 'count(freight_value)')} AS avg_shipping_cost FROM shop_items"
    )
    q["average_shipping_cost"] = q["shipping_cost_per_item"] = shipping_cost
    q["average_order_value"] = over_shop(
        f"SELECT {per('sum(price)', 'count(DISTINCT order_id)')} AS avg_order_value FROM shop_items"
    )
    monthly = "SELECT date_trunc('month', purchased)::TIMESTAMP AS month, CAST(sum(price) AS DOUBLE) AS total_revenue FROM sold"
    q["revenue_over_time"] = over_shop(f"{monthly} WHERE {DELIVERED} GROUP BY 1")
    q["revenue_trend_all_history"] = over_shop(f"{monthly} WHERE order_status = 'delivered' GROUP BY 1")

    # Geography and delivery
    by_state = f"""SELECT customer_state, {money('sum(rev)')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
                          {per('sum(rev)', 'count(DISTINCT order_id)')} AS avg_order_value
                   FROM sold WHERE {DELIVERED}"""
    q["revenue_by_state"] = over_shop(f"{by_state} GROUP BY 1")
    q["revenue_by_state_of_region"] = over_shop(f"{by_state} AND customer_state = 'NATION_7' GROUP BY 1")
    variance = "avg_actual_delivery_time_days - avg_estimated_delivery_time_days AS delivery_variance_days"
    q["shipping_performance"] = over_shop(f"SELECT *, {variance} FROM shipping", SHIPPING)
    q["shipping_punctuality"] = over_shop(
        f"""SELECT *, CASE WHEN delivery_variance_days > 0 THEN 'Late' ELSE 'Early/OnTime' END AS variance_color
            FROM (SELECT *, {variance} FROM shipping)""",
        SHIPPING,
    )
    q["delivery_breakdown"] = over_shop("SELECT * FROM breakdown", BREAKDOWN)
    q["delivery_stages"] = over_shop(
        " UNION ALL ".join(
            f"SELECT customer_state, '{c}' AS time_segment, {c} AS avg_days FROM breakdown"
            for c in ("avg_payment_processing_time", "avg_seller_handling_time", "avg_carrier_shipping_time")
        ),
        BREAKDOWN,
    )
    q["delivery_times_by_state"] = over_shop(
        f"SELECT customer_state, {days('purchased', 'arrived')} AS avg_delivery_days FROM placed WHERE {DELIVERED} GROUP BY 1"
    )
    q["delivery_against_estimate"] = over_shop(
        f"""SELECT {per('sum(a)', 'count(a)')} AS avg_actual_delivery_time,
                   {per('sum(e)', 'count(e)')} AS avg_estimated_delivery_time
            FROM (SELECT extract(day FROM arrived - purchased) AS a, extract(day FROM estimated - purchased) AS e
                  FROM shop_orders WHERE order_status = 'delivered')"""
    )

    # Features per person and order
    q["days_since_last_purchase"] = over_shop(
        f"""SELECT customer_unique_id, CAST(coalesce(extract(day FROM {NEWEST} - max(purchased)), 0) AS BIGINT)
              AS days_since_last_purchase FROM placed GROUP BY 1"""
    )
    q["order_gaps_all"] = over_shop(gaps("true", 9999))
    q["order_gaps_delivered"] = over_shop(gaps("order_status = 'delivered'", 0))
    q["order_frequency"] = over_shop(
        "SELECT customer_unique_id, count(order_id) AS total_orders FROM placed GROUP BY 1"
    )
    q["person_order_value"] = over_shop(
        f"""SELECT customer_unique_id, {money('sum(price)')} AS total_revenue, count(DISTINCT order_id) AS total_orders,
                   {per('sum(price)', 'count(price)')} AS avg_order_value FROM sold GROUP BY 1"""
    )
    q["person_mean_price"] = over_shop(
        f"SELECT customer_unique_id, {per('sum(price)', 'count(price)')} AS avg_order_value FROM sold GROUP BY 1"
    )
    q["person_payment_types"] = over_shop(
        """SELECT customer_unique_id, payment_type, count(*) AS total_payments
           FROM placed JOIN shop_payments USING (order_id) GROUP BY 1, 2"""
    )
    q["preferred_payment_types"] = over_shop(
        """SELECT customer_unique_id, payment_type AS preferred_payment_type, payments FROM (
             SELECT customer_unique_id, payment_type, count(*) AS n,
                    CAST(sum(count(*)) OVER (PARTITION BY customer_unique_id) AS BIGINT) AS payments
             FROM placed JOIN shop_payments USING (order_id) GROUP BY 1, 2)
           QUALIFY row_number() OVER (PARTITION BY customer_unique_id ORDER BY n DESC, payment_type NULLS LAST) = 1"""
    )
    q["person_mean_freight"] = over_shop(
        f"""SELECT customer_unique_id, {per('sum(freight_value)', 'count(freight_value)')} AS avg_shipping_cost
            FROM sold GROUP BY 1"""
    )
    q["person_canceled_share"] = over_shop(
        f"""SELECT customer_unique_id, {pct("count(CASE WHEN order_status = 'canceled' THEN 1 END)", 'count(*)')}
              AS estimated_return_rate FROM placed GROUP BY 1"""
    )
    q["order_values"] = over_shop("SELECT * FROM order_values", ORDER_VALUES)

    # Table updates
    q["update_customers"] = updated("*")
    for column in (
        "clv", "avg_days_between_orders", "total_orders", "avg_order_value", "avg_shipping_cost",
        "estimated_return_rate",
    ):
        q[f"update_customers_{column}"] = updated(f"customer_id, {column}")
    q["update_products_popularity"] = over_shop(
        """SELECT p.product_id, CAST(n AS DOUBLE) AS popularity_score FROM shop_products p LEFT JOIN
             (SELECT product_id, count(*) AS n FROM sold WHERE order_status = 'delivered' GROUP BY 1) USING (product_id)"""
    )
    documents = """documents_of AS (
      SELECT customer_unique_id, CAST(to_json(list({'product_id': product_id, 'total_purchases': total_purchases}
               ORDER BY product_id)) AS VARCHAR) AS product_purchases FROM pairs GROUP BY 1)"""
    q["purchase_documents"] = over_shop("SELECT *, 0::BIGINT AS document, 1 AS documents FROM documents_of", PAIRS, documents)
    q["update_customers_product_purchases"] = over_shop(
        """SELECT customer_id, customer_unique_id, product_purchases,
                  CASE WHEN product_purchases IS NOT NULL THEN 0::BIGINT END AS document,
                  CASE WHEN product_purchases IS NOT NULL THEN 1 END AS documents
           FROM shop_customers LEFT JOIN documents_of USING (customer_unique_id)""",
        PAIRS,
        documents,
    )
    q["update_orders_total_order_value"] = over_shop(
        "SELECT o.order_id, total_order_value FROM shop_orders o LEFT JOIN order_values USING (order_id)",
        ORDER_VALUES,
    )

    # Feature store and data sets
    q["person_product_counts"] = over_shop("SELECT * FROM pairs", PAIRS)
    q["product_popularity"] = over_shop(
        "SELECT product_id, count(*) AS total_sales FROM sold WHERE order_status = 'delivered' GROUP BY 1"
    )
    q["person_category_counts"] = over_shop("SELECT * FROM categories", PAIRS, CATEGORIES)

    def entries(name: str, columns: tuple[str, ...], source: str) -> str:
        body = ", ".join(f"'{c}': {c}" for c in columns)
        return f"""SELECT '{name}' AS feature_name, CAST(to_json({{{body}}}) AS VARCHAR) AS feature_value,
                          TIMESTAMP '2001-08-01 00:00:00' AS computed_at FROM {source}"""

    popularity = """(SELECT *, row_number() OVER (ORDER BY total_sales DESC, product_id) AS popularity_rank FROM
                       (SELECT product_id, count(*) AS total_sales FROM sold WHERE order_status = 'delivered' GROUP BY 1))"""
    q["product_popularity_ranked"] = over_shop(f"SELECT * FROM {popularity}")
    person = "customer_unique_id"
    q["precomputed_features"] = over_shop(
        " UNION ALL ".join(
            [
                entries("customer_product_purchases", (person, "product_id", "total_purchases"), "pairs"),
                entries("top_product_popularity", ("product_id", "total_sales", "popularity_rank"), popularity),
                entries("customer_top_categories", (person, "category", "total_purchases"), "categories"),
            ]
        ),
        PAIRS,
        CATEGORIES,
    )
    for name, unit in (("quarterly", "quarter"), ("weekly", "week"), ("daily", "day")):
        q[f"sales_series_{name}"] = over_shop(series(unit))
        q[f"sales_series_{name}_trimmed"] = trimmed(unit)
    q["sales_series_weekly_by_state"] = over_shop("SELECT * FROM state_series_all", STATE_SERIES_ALL)
    q["sales_series_levels"] = over_shop("SELECT * FROM levels", LEVELS)
    q["sales_series_level_totals"] = over_shop(
        """SELECT frequency, level, round(total, 2) AS total, series FROM
             (SELECT frequency, sum(y) AS total FROM levels WHERE level = 'shop' GROUP BY 1) JOIN
             (SELECT frequency, level, count(DISTINCT (state, category)) AS series FROM levels GROUP BY 1, 2) USING (frequency)""",
        LEVELS,
    )
    quartiles = ", ".join(
        f"round(quantile_cont(CAST(price AS DOUBLE), {share}), 6) AS {name}"
        for share, name in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))
    )
    q["price_quartiles"] = over_shop(f"SELECT {quartiles} FROM shop_items")
    q["price_quartiles_by_category"] = over_shop(
        f"SELECT product_category_name, {quartiles} FROM shop_items JOIN shop_products USING (product_id) GROUP BY 1"
    )
    q["item_prices_trimmed"] = over_shop(
        """SELECT order_id, order_item_id, product_id, price FROM priced JOIN
             (SELECT category, quantile_cont(ln(price), 0.25) AS q1, quantile_cont(ln(price), 0.75) AS q3 FROM priced GROUP BY 1)
             USING (category)
           WHERE ln(price) BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1)""",
        """priced AS (SELECT i.order_id, i.order_item_id, product_id, CAST(price AS DOUBLE) AS price, product_category_name AS category
                      FROM shop_items i JOIN shop_products USING (product_id))""",
    )
    q["segmentation_dataset"] = updated(
        """customer_unique_id, customer_state, customer_city, clv, total_orders, avg_order_value,
           avg_days_between_orders, avg_shipping_cost, estimated_return_rate"""
    )
    q["segmentation_dataset_by_person"] = updated(
        """customer_unique_id, min(customer_state) AS customer_state, min(customer_city) AS customer_city, any_value(clv) AS clv,
           any_value(total_orders) AS total_orders, any_value(avg_order_value) AS avg_order_value,
           any_value(avg_days_between_orders) AS avg_days_between_orders, any_value(avg_shipping_cost) AS avg_shipping_cost,
           any_value(estimated_return_rate) AS estimated_return_rate"""
    ) + " GROUP BY 1"
    q["recommendation_dataset"] = over_shop(
        "SELECT customer_unique_id, product_id, total_purchases AS purchase_count FROM pairs", PAIRS
    )

    # Segments
    features = (
        "clv", "total_orders", "avg_order_value", "avg_days_between_orders", "avg_shipping_cost",
        "estimated_return_rate",
    )
    known = " AND ".join(f"{f} IS NOT NULL" for f in features)
    scaled = ", ".join(
        f"round(coalesce(({f} - avg({f}) OVER ()) / nullif(stddev_pop({f}) OVER (), 0), 0), 6) AS z_{f}"
        for f in features
    )
    q["standardise"] = updated(f"customer_id, {scaled}") + f" WHERE {known}"
    q["calinski_harabasz"] = over_shop(
        """SELECT round((SELECT sum(n * (pow(ca - ga, 2) + pow(cb - gb, 2))) / (count(*) - 1)
                         FROM centres, (SELECT avg(a) AS ga, avg(b) AS gb FROM points))
                      / (SELECT sum(pow(a - ca, 2) + pow(b - cb, 2)) / (count(*) - (SELECT count(*) FROM centres))
                         FROM points JOIN centres USING (segment)), 6) AS calinski_harabasz""",
        UPDATED, POINTS, CENTRES,
    )
    q["davies_bouldin"] = over_shop(
        """SELECT round(avg(worst), 6) AS davies_bouldin FROM (
             SELECT x.segment, max((x.s + y.s) / sqrt(pow(x.ca - y.ca, 2) + pow(x.cb - y.cb, 2))) AS worst
             FROM spread x JOIN spread y ON x.segment <> y.segment GROUP BY 1)""",
        UPDATED, POINTS, CENTRES,
        """spread AS (SELECT segment, ca, cb, avg(sqrt(pow(a - ca, 2) + pow(b - cb, 2))) AS s
                      FROM points JOIN centres USING (segment) GROUP BY 1, 2, 3)""",
    )
    q["clustering_scores"] = over_shop(
        """SELECT round(silhouette, 6) AS silhouette,
                  round((SELECT sum(n * (pow(ca - ga, 2) + pow(cb - gb, 2))) / (count(*) - 1)
                         FROM centres, (SELECT avg(a) AS ga, avg(b) AS gb FROM points))
                      / (SELECT sum(pow(a - ca, 2) + pow(b - cb, 2)) / (count(*) - (SELECT count(*) FROM centres))
                         FROM points JOIN centres USING (segment)), 6) AS calinski_harabasz,
                  round((SELECT avg(worst) FROM (
                    SELECT x.segment, max((x.s + y.s) / sqrt(pow(x.ca - y.ca, 2) + pow(x.cb - y.cb, 2))) AS worst
                    FROM spread x JOIN spread y ON x.segment <> y.segment GROUP BY 1)), 6) AS davies_bouldin
           FROM silhouettes""",
        UPDATED, POINTS, CENTRES, SPREAD, silhouettes("pow(x.a - y.a, 2) + pow(x.b - y.b, 2)"),
    )
    # The sample is larger than the table at the scale where the two are compared.
    q["silhouette_on_sample"] = over_shop(
        """SELECT round(silhouette, 6) AS silhouette, rows AS sample_rows, segments FROM silhouettes""",
        UPDATED, POINTS, CENTRES, silhouettes("sqrt(pow(x.a - y.a, 2) + pow(x.b - y.b, 2))"),
    )
    q["segment_members"] = over_shop(
        """SELECT segment, row_number() OVER nearest AS member_rank, customer_unique_id, distance,
                  round(a, 6) AS clv, round(b, 6) AS avg_shipping_cost FROM (
             SELECT *, round(sqrt(pow((a - ca) / sa, 2) + pow((b - cb) / sb, 2)), 6) AS distance
             FROM points JOIN centres USING (segment), (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM points))
           WINDOW nearest AS (PARTITION BY segment ORDER BY distance, customer_unique_id)
           QUALIFY row_number() OVER nearest <= 5""",
        UPDATED, POINTS, CENTRES,
    )
    q["segment_split"] = updated(
        f"{known} AS clustered, count(*) AS rows, count(DISTINCT customer_unique_id) AS persons"
    ) + " GROUP BY 1"
    q["segment_summary_by_rule"] = over_shop(
        """SELECT segment AS segment_label, count(DISTINCT customer_unique_id) AS number_of_customers,
                  round(avg(a), 6) AS avg_clv, round(avg(avg_order_value), 6) AS avg_aov_segment,
                  round(avg(total_orders), 6) AS avg_order_frequency_segment
           FROM points GROUP BY 1""",
        UPDATED, POINTS,
    )

    # Forecasts
    q["train_test_split"] = over_shop("SELECT * FROM split", STATE_SERIES_ALL, SPLIT)
    naive = """naive AS (
      SELECT s.series_id, s.y, t.last_value FROM split s JOIN
        (SELECT series_id, arg_max(y, ds) AS last_value FROM split WHERE NOT is_test GROUP BY 1) t USING (series_id)
      WHERE is_test)"""
    q["metrics_of_last_value"] = over_shop(
        """SELECT series_id, round(avg(abs(y - last_value) / greatest(abs(y), 2.220446049250313e-16)) * 100, 6) AS mape_pct,
                  round(sqrt(avg(pow(y - last_value, 2))), 6) AS rmse, round(avg(abs(y - last_value)), 6) AS mae,
                  round(1 - sum(pow(y - last_value, 2)) / (var_pop(y) * count(y)), 6) AS r2
           FROM naive GROUP BY 1""",
        STATE_SERIES_ALL, SPLIT, naive,
    )

    everything = "split_levels AS (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY ds DESC) AS k FROM levels)"
    q["forecast_test_rows"] = over_shop(
        "SELECT series_id, ds, y FROM split_levels WHERE k <= 6 AND frequency IN ('weekly', 'daily')", LEVELS, everything
    )
    line = """trend AS (
      SELECT s.series_id, s.y, t.ym + coalesce(t.slope, 0) * (s.ds - DATE '1970-01-01' - t.xm) AS line FROM split s JOIN
        (SELECT series_id, regr_slope(y, ds - DATE '1970-01-01') AS slope, avg(y) AS ym, avg(ds - DATE '1970-01-01') AS xm
         FROM split WHERE NOT is_test AND y IS NOT NULL GROUP BY 1) t USING (series_id) WHERE is_test)"""
    q["metrics_of_linear_trend"] = over_shop(
        """SELECT series_id, round(avg(abs(y - line) / greatest(abs(y), 2.220446049250313e-16)) * 100, 6) AS mape_pct,
                  round(sqrt(avg(pow(y - line, 2))), 6) AS rmse, round(avg(abs(y - line)), 6) AS mae,
                  round(1 - sum(pow(y - line, 2)) / (var_pop(y) * count(y)), 6) AS r2
           FROM trend GROUP BY 1""",
        STATE_SERIES_ALL, SPLIT, line,
    )

    given = """given AS (
      SELECT s.series_id, s.ds, s.y, t.last AS arima, t.ym + coalesce(t.slope, 0) * (s.ds - DATE '1970-01-01' - t.xm) AS seasonal
      FROM split s JOIN
        (SELECT series_id, arg_max(y, ds) AS last, regr_slope(y, ds - DATE '1970-01-01') AS slope, avg(y) AS ym,
                avg(ds - DATE '1970-01-01') AS xm
         FROM split WHERE NOT is_test AND y IS NOT NULL GROUP BY 1) t USING (series_id) WHERE is_test)"""
    models = ("arima", "seasonal", "ensemble")
    q["ensemble_of_baselines"] = over_shop(
        """SELECT series_id, ds, round(y, 6) AS y, round(arima, 6) AS arima, round(seasonal, 6) AS seasonal,
                  round((arima + seasonal) / 2, 6) AS ensemble FROM given""",
        STATE_SERIES_ALL, SPLIT, given,
    )
    q["metrics_of_baselines"] = over_shop(
        """SELECT series_id, model, round(avg(abs(y - f) / greatest(abs(y), 2.220446049250313e-16)) * 100, 6) AS mape_pct,
                  round(sqrt(avg(pow(y - f, 2))), 6) AS rmse, round(avg(abs(y - f)), 6) AS mae,
                  round(1 - sum(pow(y - f, 2)) / (var_pop(y) * count(y)), 6) AS r2
           FROM long GROUP BY 1, 2""",
        STATE_SERIES_ALL, SPLIT, given,
        "with_mean AS (SELECT *, (arima + seasonal) / 2 AS ensemble FROM given)",
        "long AS (" + " UNION ALL ".join(f"SELECT series_id, y, '{m}' AS model, {m} AS f FROM with_mean" for m in models) + ")",
    )

    # Cleaning over the raw tables made from the sample tables
    q["clean_customers"] = """
      SELECT o_custkey AS customer_id, o_orderpriority AS customer_city FROM orders
      QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1"""
    q["clean_products"] = """
      SELECT p.*, english AS product_category_name_english FROM
        (SELECT p_partkey AS product_id, CAST(length(p_name) AS INT) AS product_name_length,
                CAST(length(p_type) AS INT) AS product_description_length,
                CASE WHEN p_brand <> 'Brand#2' THEN p_brand ELSE 'unknown' END AS product_category_name FROM part) p
      LEFT JOIN (SELECT DISTINCT p_brand, upper(p_brand) AS english FROM part
                 WHERE p_brand NOT IN ('Brand#2', 'Brand#3')) ON p_brand = product_category_name"""
    q["clean_orders"] = """
      SELECT DISTINCT o_orderkey AS order_id, o_custkey AS customer_id, o_orderstatus AS order_status,
             o_orderdate AS order_purchase_timestamp,
             CASE WHEN o_orderstatus <> 'P' THEN o_orderdate END AS order_approved_at,
             CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS order_delivered_carrier_date,
             NULL::TIMESTAMP AS order_delivered_customer_date, o_orderdate AS order_estimated_delivery_date
      FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_orderpriority <> '5-LOW'"""
    q["clean_order_items"] = """
      SELECT l_orderkey AS order_id, CAST(l_linenumber AS BIGINT) AS order_item_id,
             CASE WHEN l_returnflag <> 'R' THEN l_shipdate END AS shipping_limit_date FROM lineitem"""
    q["clean_reviews"] = """
      SELECT conv_id AS review_id, CASE WHEN role <> 'user' THEN role ELSE 'No Title' END AS review_comment_title,
             coalesce(text, 'No Message') AS review_comment_message,
             TIMESTAMP '2018-01-02 03:04:05' AS review_creation_date, NULL::TIMESTAMP AS review_answer_timestamp
      FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) = 1"""
    q["clean_geolocation"] = """
      SELECT c_nationkey AS geolocation_zip_code_prefix, c_acctbal AS geolocation_lat FROM customer
      QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) = 1"""
    q["clean_payments"] = over_shop(
        """SELECT payment_id, order_id, payment_type, CAST(order_id % 12 + 1 AS INT) AS payment_installments,
                  CAST(payment_value AS DOUBLE) AS payment_value, 1 AS payment_sequential FROM shop_payments"""
    )
    q["clean_sellers"] = over_shop("SELECT * FROM shop_sellers")
    q["fix_missing_zip_codes"] = over_shop(
        """SELECT * FROM shop_places UNION ALL
           SELECT zip, NULL::DOUBLE, NULL::DOUBLE, 'Unknown', 'XX' FROM
             (SELECT customer_zip_code_prefix AS zip FROM shop_customers UNION SELECT seller_zip_code_prefix FROM shop_sellers)
           WHERE zip NOT IN (SELECT geolocation_zip_code_prefix FROM shop_places)"""
    )

    # Quality
    keyed = (
        ("customers", "shop_customers", "customer_id"), ("sellers", "shop_sellers", "seller_id"),
        ("products", "shop_products", "product_id"), ("orders", "shop_orders", "order_id"),
        ("order_items", "shop_items", "order_item_id"), ("payments", "shop_payments", "payment_id"),
        ("reviews", "shop_reviews", "review_id"), ("geolocation", "shop_places", "geolocation_zip_code_prefix"),
    )
    q["key_report"] = over_shop(
        " UNION ALL ".join(
            f"""SELECT '{t}' AS table_name, count(*) AS bad_keys, CAST(coalesce(sum(n), 0) AS BIGINT) AS bad_rows
                FROM (SELECT {k}, count(*) AS n FROM {v} GROUP BY 1 HAVING count(*) > 1 OR {k} IS NULL)"""
            for t, v, k in keyed
        )
    )
    references = (
        ("orders", "customer_id", "shop_orders", "known_customers", "customer_id"),
        ("order_items", "order_id", "shop_items", "shop_orders", "order_id"),
        ("order_items", "product_id", "shop_items", "known_products", "product_id"),
        ("order_items", "seller_id", "shop_items", "shop_sellers", "seller_id"),
        ("payments", "order_id", "shop_payments", "shop_orders", "order_id"),
        ("reviews", "order_id", "shop_reviews", "shop_orders", "order_id"),
    )
    known_customers = "known_customers AS (SELECT c_custkey AS customer_id FROM customer WHERE c_acctbal >= 0)"
    known_products = "known_products AS (SELECT * FROM shop_products WHERE product_category_name <> 'Brand#3')"
    q["orphan_report"] = over_shop(
        " UNION ALL ".join(
            f"""SELECT '{t}.{c}' AS reference, count(DISTINCT {c}) AS orphan_keys, count(*) AS orphan_rows
                FROM {v} WHERE {c} IS NOT NULL AND {c} NOT IN (SELECT {k} FROM {p})"""
            for t, c, v, p, k in references
        ),
        known_customers,
        known_products,
    )
    q["cascade_order_items"] = over_shop(
        """SELECT order_id, order_item_id, product_id, seller_id FROM shop_items
           WHERE product_id IN (SELECT product_id FROM known_products) AND order_id IN
             (SELECT order_id FROM shop_orders WHERE customer_id IN (SELECT customer_id FROM known_customers))""",
        known_customers,
        known_products,
    )
    q["score_violations"] = """SELECT l_orderkey AS order_id, l_linenumber AS review_score FROM lineitem
                               WHERE l_linenumber < 1 OR l_linenumber > 5"""
    widths = {
        "geolocation": (("geolocation_city", 255), ("geolocation_state", 10)),
        "customers": (("customer_id", 50), ("customer_unique_id", 50), ("customer_city", 255), ("customer_state", 10)),
        "sellers": (("seller_id", 50), ("seller_city", 255), ("seller_state", 10)),
        "products": (("product_id", 50), ("product_category_name", 255)),
        "orders": (("order_id", 50), ("customer_id", 50), ("order_status", 50)),
        "order_items": (("order_id", 50), ("product_id", 50), ("seller_id", 50)),
        "payments": (("order_id", 50), ("payment_type", 50)),
        "reviews": (("review_id", 50), ("order_id", 50)),
    }
    views = {t: v for t, v, _ in keyed} | {
        "customers": "(SELECT * REPLACE (c_name AS customer_state) FROM shop_customers JOIN customer "
        "ON c_custkey = customer_id WHERE c_acctbal >= 0)",
        "products": "known_products",
    }
    reports = [
        f"""SELECT '{t}' AS table_name, '{c}' AS column_name,
                   count(CASE WHEN length(CAST({c} AS VARCHAR)) > {w} THEN 1 END) AS violations FROM {views[t]}"""
        for t, columns in widths.items()
        for c, w in columns
    ]
    reports += [
        f"""SELECT '{t}', '{c}', count(CASE WHEN abs({v}) >= 99999999.995 THEN 1 END) FROM {views[t]}"""
        for t, c, v in (
            ("order_items", "price", "price"),
            ("order_items", "freight_value", "freight_value"),
            ("payments", "payment_value", "CAST(payment_value AS DECIMAL(20,2)) * 1000"),
        )
    ]
    q["width_report"] = over_shop(" UNION ALL ".join(reports), known_products)

    # Facts and SQL
    q["parameterised_sql"] = q["status_distribution"]
    q["order_fact"] = over_shop(
        """SELECT o.order_id, o.customer_id, o.order_status, o.purchased AS order_purchase_timestamp,
                  o.approved AS order_approved_at, o.carrier AS order_delivered_carrier_date,
                  o.arrived AS order_delivered_customer_date, o.estimated AS order_estimated_delivery_date,
                  c.customer_unique_id, c.customer_state, c.customer_city, c.customer_id IS NOT NULL AS has_customer,
                  CAST(revenue * 100 AS BIGINT) AS revenue_cents, revenue_count,
                  CAST(price_total * 100 AS BIGINT) AS price_cents, price_count,
                  CAST(freight_total * 100 AS BIGINT) AS freight_cents, freight_count, item_rows, item_count,
                  CAST(total_order_value * 100 AS BIGINT) AS weighted_cents,
                  CAST(date_trunc('month', o.purchased) AS DATE) AS purchase_month
           FROM shop_orders o LEFT JOIN shop_customers c USING (customer_id) LEFT JOIN
             (SELECT order_id, sum(price + freight_value) AS revenue, count(price + freight_value) AS revenue_count,
                     sum(price) AS price_total, count(price) AS price_count, sum(freight_value) AS freight_total,
                     count(freight_value) AS freight_count, count(*) AS item_rows, count(order_item_id) AS item_count,
                     sum(price * order_item_id) + sum(freight_value * order_item_id) AS total_order_value
              FROM shop_items GROUP BY 1) t USING (order_id)"""
    )
    q["sales_fact"] = over_shop(
        """SELECT s.order_id, s.customer_id, s.order_item_id, s.product_id, s.seller_id, CAST(s.price AS DOUBLE) AS price,
                  CAST(s.freight_value AS DOUBLE) AS freight_value,
                  s.order_status, s.purchased AS order_purchase_timestamp, s.customer_unique_id, s.customer_state,
                  true AS has_customer, product_category_name, product_category_name_english,
                  p.product_id IS NOT NULL AS has_product,
                  CAST(date_trunc('month', s.purchased) AS DATE) AS purchase_month, s.shipping_limit_date
           FROM sold s LEFT JOIN shop_products p USING (product_id)"""
    )
    for name in (
        "main_kpis", "revenue_orders_trend_month", "new_vs_returning_revenue", "category_performance",
        "delivery_breakdown", "update_customers",
    ):
        q[f"{name}_of_facts"] = q[name]
    return q
