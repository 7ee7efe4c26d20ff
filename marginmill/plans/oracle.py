"""The registered queries in plain SQL, written row by row from the definitions, for comparison."""

BASE = """
WITH items AS (
  SELECT l_orderkey AS order_id, l_partkey AS product_id, l_linenumber AS item_no, l_extendedprice AS price,
    l_suppkey AS supplier_id, l_quantity AS quantity, l_discount AS discount, l_tax AS tax, l_returnflag AS return_flag,
    l_linestatus AS line_status, l_shipdate AS ship_date
  FROM lineitem),
ord AS (
  SELECT o_orderkey AS order_id, o_custkey AS customer_id, o_orderdate AS placed, o_orderstatus AS order_status,
    o_totalprice AS total_price, o_orderpriority AS order_priority
  FROM orders),
cust AS (
  SELECT c_custkey AS customer_id, c_name AS customer_unique_id, c_nationkey AS nation_id, c_acctbal AS account_balance,
    c_mktsegment AS market_segment
  FROM customer),
pay AS (SELECT o_orderkey AS order_id, o_totalprice AS payment_value FROM orders),
tr AS (SELECT 'Brand#' || n AS brand, 'category_' || n AS category FROM range(1, 24) AS r(n)),
prod AS (SELECT p_partkey AS product_id, p_brand AS brand, category FROM part LEFT JOIN tr ON p_brand = tr.brand),
camp AS (SELECT * FROM (VALUES
  ('C001', 'New Year Sale', 'Email', 10, 5000), ('C002', 'Summer Sale', 'Google Ads', 15, 8000),
  ('C003', 'Festival Sale', 'Social Media', 20, 12000), ('C004', 'Flash Sale', 'Influencer', 25, 10000),
  ('C005', 'Weekend Bonanza', 'SMS', 5, 3000)) AS t(campaign_id, campaign_name, channel, discount_pct, budget)),
costs AS (
  SELECT product_id,
    round_even(mean_price * (0.5::DOUBLE + 0.35::DOUBLE * draw / 4294967296.0::DOUBLE) * 100, 0) / 100 AS cost_price
  FROM (SELECT product_id, sum(price::DECIMAL(18,2))::DOUBLE / count(price) AS mean_price,
          ('0x' || substr(md5(product_id::VARCHAR), 1, 8))::BIGINT AS draw
        FROM items GROUP BY product_id)),
mapping AS (
  SELECT order_id, 'C00' || (('0x' || substr(md5(order_id::VARCHAR), 1, 8))::BIGINT % 5 + 1) AS campaign_id FROM ord),
sales AS (
  SELECT i.*, cost_price, price AS revenue, price - cost_price AS gross_profit,
    (price - cost_price) / nullif(price, 0) * 100.0::DOUBLE AS profit_margin_pct
  FROM items i LEFT JOIN costs USING (product_id)),
spend AS (
  SELECT customer_id, sum(price::DECIMAL(18,2))::DOUBLE / count(price) AS avg_spend
  FROM items JOIN ord USING (order_id) GROUP BY customer_id),
seg AS (
  SELECT customer_id, customer_unique_id,
    CASE WHEN coalesce(avg_spend, 0) >= 57000 THEN 'Premium' WHEN coalesce(avg_spend, 0) >= 53000 THEN 'High Value'
         WHEN coalesce(avg_spend, 0) >= 49000 THEN 'Regular' ELSE 'Occasional' END AS customer_segment
  FROM cust LEFT JOIN spend USING (customer_id)),
names AS (SELECT * FROM (VALUES ('Premium', 'Big Spenders'), ('High Value', 'Frequent Shoppers'),
  ('Regular', 'Normal Shoppers'), ('Occasional', 'Rare Shoppers')) AS t(customer_segment, plain_name)),
cat_sales AS (
  SELECT sales.*, prod.category AS category, coalesce(prod.category, 'unknown') AS category_kept
  FROM sales LEFT JOIN prod USING (product_id)),
ord_sales AS (
  SELECT cat_sales.*, customer_id, placed, order_status, total_price, order_priority FROM cat_sales JOIN ord USING (order_id)),
seg_sales AS (
  SELECT ord_sales.*, customer_segment, plain_name
  FROM ord_sales JOIN seg USING (customer_id) LEFT JOIN names USING (customer_segment)),
camp_sales AS (
  SELECT cat_sales.*, campaign_id, campaign_name, channel, discount_pct, budget
  FROM cat_sales LEFT JOIN mapping USING (order_id) LEFT JOIN camp USING (campaign_id)),
cat AS (
  SELECT category, {revenue} AS revenue, {profit} AS profit, {margin} AS avg_margin_pct, count(*) AS volume
  FROM cat_sales WHERE category IS NOT NULL GROUP BY category),
cust_cat AS (
  SELECT category, {revenue} AS revenue, {profit} AS profit, {margin} AS avg_margin_pct
  FROM seg_sales WHERE category IS NOT NULL GROUP BY category),
roi AS (
  SELECT *, (gross_profit - budget) / budget * 100 AS roi_pct
  FROM (SELECT campaign_id, campaign_name, channel, discount_pct, budget, {revenue} AS revenue,
          {profit} AS gross_profit, count(DISTINCT order_id) AS total_orders
        FROM camp_sales WHERE campaign_id IS NOT NULL GROUP BY ALL)),
disc AS (
  SELECT *, profit / nullif(revenue, 0) * 100 AS margin_pct
  FROM (SELECT discount_pct, {revenue} AS revenue, {profit} AS profit, count(order_id) AS units_sold
        FROM camp_sales WHERE discount_pct IS NOT NULL GROUP BY discount_pct)),
advice AS (
  SELECT *, CASE
      WHEN revenue > mean_r AND profit > mean_p THEN '🚀 Pay for more ads (Very Profitable)'
      WHEN revenue > mean_r AND profit <= mean_p THEN '⚠️ Give fewer discounts (Losing money on discounts)'
      WHEN revenue <= mean_r AND profit <= mean_p THEN '🛑 Stop/Review this category (Not selling well)'
      ELSE '🎯 Give small discounts to specific customers' END AS what_to_do
  FROM cust_cat, (SELECT avg(revenue) AS mean_r, avg(profit) AS mean_p FROM cust_cat)),
choices AS (
  SELECT category, segment
  FROM (SELECT DISTINCT category FROM seg_sales WHERE category IS NOT NULL),
    (VALUES ('All Customers'), ('Big Spenders'), ('Frequent Shoppers'), ('Normal Shoppers'), ('Rare Shoppers')) AS t(segment)),
fine AS (
  SELECT category, plain_name AS segment, count(*) AS base_units,
    sum(price::DECIMAL(18,2))::DOUBLE / count(price) AS avg_price,
    sum(cost_price::DECIMAL(18,2))::DOUBLE / count(cost_price) AS avg_cost
  FROM seg_sales WHERE category IS NOT NULL AND plain_name IS NOT NULL GROUP BY 1, 2),
coarse AS (
  SELECT category, count(*) AS base_units, sum(price::DECIMAL(18,2))::DOUBLE / count(price) AS avg_price,
    sum(cost_price::DECIMAL(18,2))::DOUBLE / count(cost_price) AS avg_cost
  FROM seg_sales WHERE category IS NOT NULL GROUP BY 1),
base AS (
  SELECT c.category, c.segment, coalesce(f.base_units, k.base_units) AS base_units,
    CASE WHEN f.base_units IS NULL THEN k.avg_price ELSE f.avg_price END AS avg_price,
    CASE WHEN f.base_units IS NULL THEN k.avg_cost ELSE f.avg_cost END AS avg_cost
  FROM choices c LEFT JOIN fine f USING (category, segment) JOIN coarse k ON k.category = c.category),
scen AS (
  SELECT *, greatest(1, round_even(base_units::DOUBLE
      * CASE discount_pct WHEN 5 THEN 1.0::DOUBLE WHEN 10 THEN 1.25::DOUBLE WHEN 15 THEN 1.15::DOUBLE
             WHEN 20 THEN 0.95::DOUBLE WHEN 25 THEN 1.40::DOUBLE ELSE 1.0::DOUBLE END
      * (1.0::DOUBLE + 0.25::DOUBLE * ln(1.0::DOUBLE + (budget - 1000) / 4000.0::DOUBLE)) * 0.05::DOUBLE, 0)::BIGINT) AS units,
    avg_price * (1 - discount_pct / 100.0::DOUBLE) AS unit_price
  FROM base, (VALUES (5), (10), (15), (20), (25)) AS d(discount_pct),
    (SELECT b::INTEGER AS budget FROM range(1000, 30001, 1000) AS r(b))),
fc AS (
  SELECT *, units * unit_price AS revenue, units * avg_cost AS cost, units * unit_price - units * avg_cost AS profit,
    CASE WHEN units * unit_price > 0 THEN (units * unit_price - units * avg_cost) / (units * unit_price) * 100 ELSE 0 END AS margin_pct,
    (units * unit_price - units * avg_cost - budget) / budget * 100 AS roi_pct
  FROM scen),
q AS (SELECT conv_id, turn, text FROM conversations WHERE role = 'user'),
turns AS (SELECT conv_id, turn, role, text FROM conversations),
intents AS (
  SELECT conv_id, turn, CASE
    WHEN contains(t, 'discount') OR contains(t, 'offer') OR contains(t, 'percent') OR contains(t, 'sweet spot') THEN 'discount'
    WHEN contains(t, 'campaign') OR contains(t, 'roi') OR contains(t, 'marketing') OR contains(t, 'channel') THEN 'campaign'
    WHEN contains(t, 'customer') OR contains(t, 'segment') OR contains(t, 'premium') OR contains(t, 'high value') OR contains(t, 'regular') THEN 'segment'
    WHEN contains(t, 'category') OR contains(t, 'categories') OR contains(t, 'product') THEN 'category'
    WHEN contains(t, 'select') AND contains(t, 'from') THEN 'sql' ELSE 'default' END AS intent
  FROM (SELECT conv_id, turn, lower(text) AS t FROM q))
"""

FORMULAS = {
    "{revenue}": "coalesce(sum(revenue::DECIMAL(18,2))::DOUBLE, 0)",
    "{profit}": "coalesce(sum(gross_profit::DECIMAL(18,2))::DOUBLE, 0)",
    "{cost}": "coalesce(sum(cost_price::DECIMAL(18,2))::DOUBLE, 0)",
    "{margin}": "round(avg(profit_margin_pct), 6)",
    "{price}": "coalesce(sum(price::DECIMAL(18,2))::DOUBLE, 0)",
    "{mean}": "sum(price::DECIMAL(18,2))::DOUBLE / count(price)",
    "{what}": "order_id, product_id, item_no",
}


def _summary(table: str, columns: list[str]) -> str:
    return " UNION ALL ".join(
        f"""SELECT '{c}' AS metric, count({c}) AS count, round(sum({c}::DECIMAL(18,2))::DOUBLE / count({c}), 6) AS mean,
        round(stddev_samp({c}), 6) AS std, round(min({c}), 2) AS min, round(quantile_cont(round({c}, 2), 0.25), 6) AS q25,
        round(quantile_cont(round({c}, 2), 0.5), 6) AS q50, round(quantile_cont(round({c}, 2), 0.75), 6) AS q75,
        round(max({c}), 2) AS max FROM {table}"""
        for c in columns
    )


TREATMENT = """CASE plain_name WHEN 'Big Spenders' THEN 'no discounts: offer fast delivery or gift wrapping'
  WHEN 'Frequent Shoppers' THEN 'spend-and-save deals for the next visit'
  WHEN 'Normal Shoppers' THEN 'weekend sales of 10% to 15%'
  WHEN 'Rare Shoppers' THEN 'large clearance discounts of about 20%' END"""

STEPS = """CASE what_to_do
  WHEN '🚀 Pay for more ads (Very Profitable)' THEN 'This item sells in high volumes and keeps a good profit. Spend more on ads to get more customers!'
  WHEN '⚠️ Give fewer discounts (Losing money on discounts)' THEN 'You sell a lot of these items, but make very little profit because you give too many discounts. Raise the price or stop discounts!'
  WHEN '🛑 Stop/Review this category (Not selling well)' THEN 'These items are not selling well and do not bring in profit. Review buying costs or stop selling them.'
  ELSE 'These items have high profit margins but low sales volume. Offer small discounts to Big Spenders to get them to buy more.' END"""

GLOSSARY_SQL = """replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(replace(text,
  'Offline Pricing & Discount Analysis', 'Simple Discount Analysis'),
  'Offline Campaign Performance & ROI Diagnostics', 'Simple Advertisement Worth Analysis'),
  'Offline Customer Segment Performance Analysis', 'Simple Customer Types Analysis'),
  'Offline Category Profitability Analysis', 'Simple Product Types Analysis'),
  'gross profit', 'actual profit'), 'ROI (%)', 'Worth / ROI %'), 'customer_segment', 'customer type'),
  'revenue', 'sales'), 'Premium', 'Big Spenders'), 'High Value', 'Frequent Shoppers'),
  'Regular', 'Normal Shoppers'), 'Occasional', 'Rare Shoppers')"""

QUERIES = {
    "q01_total_orders": "SELECT count(*) AS total_orders FROM ord",
    "q02_total_payments": "SELECT round(sum(payment_value::DECIMAL(18,2)), 2)::DOUBLE AS total_revenue FROM pay",
    "q03_product_costs": "SELECT product_id, cost_price FROM costs",
    "q04_campaigns_used": """SELECT camp.*, orders FROM camp
        LEFT JOIN (SELECT campaign_id, count(order_id) AS orders FROM mapping GROUP BY 1) USING (campaign_id)""",
    "q05_campaign_mapping": "SELECT order_id, campaign_id FROM mapping",
    "q06_sales_features": "SELECT * FROM sales",
    "q07_sales_stats": _summary("sales", ["revenue", "cost_price", "gross_profit"]),
    "q08_customer_segments": "SELECT customer_id, customer_unique_id, customer_segment FROM seg",
    "q09_segment_counts": "SELECT customer_segment, count(*) AS customers FROM seg GROUP BY 1",
    "q10_kpi_summary": """SELECT {revenue} AS total_revenue, {profit} AS total_profit, {margin} AS avg_margin_pct,
        count(DISTINCT order_id) AS total_orders FROM sales""",
    "q11_executive_kpis": """SELECT *, total_revenue / total_orders AS aov FROM (
        SELECT {revenue} AS total_revenue, {profit} AS total_profit, {margin} AS avg_margin_pct, {cost} AS total_cost,
          count(DISTINCT order_id) AS total_orders FROM ord_sales)""",
    "q12_top_products": """SELECT product_id, {profit} AS gross_profit FROM sales GROUP BY 1
        ORDER BY gross_profit DESC, product_id LIMIT 10""",
    "q13_top_products_by_category": """SELECT product_id, category, {revenue} AS revenue, {profit} AS gross_profit,
        {margin} AS avg_margin_pct FROM ord_sales WHERE category IS NOT NULL GROUP BY 1, 2
        ORDER BY gross_profit DESC, product_id LIMIT 10""",
    "q14_monthly_trend": """SELECT strftime(placed, '%Y-%m') AS month, {revenue} AS revenue, {profit} AS gross_profit
        FROM ord_sales WHERE strftime(placed, '%Y-%m') BETWEEN '1996-01' AND '1999-12' GROUP BY 1""",
    "q15_cost_profit_split": """SELECT unnest(['cost', 'profit']) AS part, unnest([c, p]) AS amount,
        unnest([c / (c + p) * 100, p / (c + p) * 100]) AS share_pct
        FROM (SELECT {cost} AS c, {profit} AS p FROM ord_sales)""",
    "q16_top_category_by_profit": """SELECT category, {profit} AS gross_profit FROM ord_sales WHERE category IS NOT NULL
        GROUP BY 1 ORDER BY gross_profit DESC, category LIMIT 1""",
    "q17_margin_health": """SELECT *, CASE WHEN margin_pct < 40 THEN 'low' ELSE 'good' END AS health FROM (
        SELECT r AS total_revenue, p AS total_profit, p / r * 100 AS margin_pct
        FROM (SELECT {revenue} AS r, {profit} AS p FROM ord_sales))""",
    "q18_top_categories_by_revenue": "SELECT category, revenue FROM cat ORDER BY revenue DESC, category LIMIT 10",
    "q19_top_categories_by_profit": "SELECT category, profit AS gross_profit FROM cat ORDER BY profit DESC, category LIMIT 10",
    "q20_category_performance": "SELECT * FROM cat",
    "q21_category_benchmarks": """SELECT category, revenue, avg_margin_pct, revenue_line, margin_line,
        (CASE WHEN revenue >= revenue_line THEN 'high sales' ELSE 'low sales' END) || ', ' ||
        (CASE WHEN avg_margin_pct >= margin_line THEN 'high share' ELSE 'low share' END) AS quadrant
        FROM cat, (SELECT median(revenue) AS revenue_line, round(avg(avg_margin_pct), 6) AS margin_line FROM cat)""",
    "q22_category_list": "SELECT DISTINCT category FROM cat_sales WHERE category IS NOT NULL",
    "q23_category_detail": """SELECT category_kept AS category, {revenue} AS revenue, {profit} AS gross_profit,
        {margin} AS avg_margin_pct, count(order_id) AS items FROM cat_sales GROUP BY 1""",
    "q24_category_campaign": """SELECT category_kept AS category, campaign_name, discount_pct, {revenue} AS revenue,
        {profit} AS gross_profit, count(order_id) AS items FROM camp_sales WHERE campaign_name IS NOT NULL GROUP BY 1, 2, 3""",
    "q25_top_products_in_category": """SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY category ORDER BY gross_profit DESC, product_id)::INTEGER AS rank FROM (
          SELECT product_id, category, {revenue} AS revenue, {profit} AS gross_profit, {margin} AS avg_margin_pct
          FROM cat_sales WHERE category IS NOT NULL GROUP BY 1, 2)) WHERE rank <= 5""",
    "q26_category_margin_advice": """SELECT category, avg_margin_pct, CASE WHEN avg_margin_pct < 20 THEN 'stop discounts'
        WHEN avg_margin_pct > 40 THEN 'small discount' ELSE 'hold prices' END AS advice FROM cat""",
    "q27_marketing_insights": """SELECT
        (SELECT category FROM cat ORDER BY revenue DESC, category LIMIT 1) AS top_revenue_category,
        (SELECT max(revenue) FROM cat) AS top_revenue,
        (SELECT category FROM cat ORDER BY profit DESC, category LIMIT 1) AS top_profit_category,
        (SELECT max(profit) FROM cat) AS top_profit""",
    "q28_promotion_recommendations": """SELECT category, revenue, profit, avg_margin_pct, CASE
          WHEN revenue > mean_r AND profit > mean_p THEN 'Increase promotion budget'
          WHEN revenue > mean_r AND profit < mean_p THEN 'Reduce discounts and improve margins'
          WHEN revenue < mean_r AND profit < mean_p THEN 'Review category strategy'
          ELSE 'Test targeted promotions' END AS recommendation
        FROM cat, (SELECT avg(revenue) AS mean_r, avg(profit) AS mean_p FROM cat)
        ORDER BY profit DESC, category LIMIT 15""",
    "q29_strategy_advice": f"SELECT category, revenue, profit, avg_margin_pct, what_to_do, {STEPS} AS action_steps FROM advice",
    "q30_segment_profitability": """SELECT customer_segment, round({revenue}, 2) AS revenue, round({profit}, 2) AS gross_profit,
        round(avg(profit_margin_pct), 2) AS avg_margin_pct
        FROM sales LEFT JOIN ord USING (order_id) LEFT JOIN seg USING (customer_id)
        WHERE customer_segment IS NOT NULL GROUP BY 1""",
    "q31_best_segment": """SELECT customer_segment, round({profit}, 2) AS gross_profit FROM seg_sales GROUP BY 1
        ORDER BY gross_profit DESC, customer_segment LIMIT 1""",
    "q32_segment_summary": """SELECT *, revenue / total_orders AS aov FROM (
        SELECT plain_name AS segment, {revenue} AS revenue, {profit} AS profit, {margin} AS avg_margin_pct,
          count(DISTINCT order_id) AS total_orders FROM seg_sales GROUP BY 1)""",
    "q33_segment_top_categories": """SELECT * FROM (
        SELECT *, row_number() OVER (PARTITION BY customer_segment ORDER BY revenue DESC, category)::INTEGER AS rank FROM (
          SELECT plain_name AS customer_segment, category_kept AS category, {revenue} AS revenue,
            {profit} AS gross_profit, count(order_id) AS items FROM seg_sales GROUP BY 1, 2)) WHERE rank <= 5""",
    "q34_segment_advice": f"""SELECT plain_name AS segment, {{revenue}} AS revenue, {TREATMENT} AS treatment
        FROM seg_sales GROUP BY plain_name""",
    "q35_campaign_roi": "SELECT * EXCLUDE (total_orders) FROM roi",
    "q35_campaign_roi_drawn": "SELECT * EXCLUDE (total_orders) FROM roi",
    "q36_campaign_performance": "SELECT * FROM roi",
    "q37_campaign_kpis": """SELECT
        (SELECT campaign_name FROM roi ORDER BY roi_pct DESC, campaign_id LIMIT 1) AS best_campaign,
        (SELECT max(roi_pct) FROM roi) AS best_roi_pct,
        (SELECT campaign_name FROM roi ORDER BY roi_pct, campaign_id DESC LIMIT 1) AS worst_campaign,
        (SELECT min(roi_pct) FROM roi) AS worst_roi_pct,
        (SELECT campaign_name FROM roi ORDER BY gross_profit DESC, campaign_id LIMIT 1) AS max_profit_campaign,
        (SELECT max(gross_profit) FROM roi) AS max_profit,
        (SELECT sum(budget)::BIGINT FROM roi) AS total_budget""",
    "q38_channel_roi": """SELECT channel, p AS gross_profit, b AS budget, (p - b) / b * 100 AS roi_pct FROM (
        SELECT channel, round(sum(gross_profit), 2) AS p, sum(budget)::BIGINT AS b FROM roi GROUP BY 1)""",
    "q39_campaign_verdict": """(SELECT 'best' AS place, campaign_name, roi_pct, 'repeat' AS verdict FROM roi
          ORDER BY roi_pct DESC, campaign_id LIMIT 1)
        UNION ALL (SELECT 'worst', campaign_name, roi_pct, CASE WHEN roi_pct < 0 THEN 'stop' ELSE 'watch' END FROM roi
          ORDER BY roi_pct, campaign_id DESC LIMIT 1)""",
    "q40_discount_effectiveness": "SELECT discount_pct, revenue, profit AS gross_profit, margin_pct FROM disc",
    "q40_recommended_discount": """SELECT discount_pct, profit AS gross_profit FROM disc
        ORDER BY profit DESC, discount_pct LIMIT 1""",
    "q41_discount_performance": "SELECT * FROM disc",
    "q42_discount_kpis": """SELECT
        (SELECT discount_pct FROM disc ORDER BY profit DESC, discount_pct LIMIT 1) AS best_profit_discount_pct,
        (SELECT max(profit) FROM disc) AS best_profit,
        (SELECT discount_pct FROM disc ORDER BY margin_pct DESC, discount_pct LIMIT 1) AS best_margin_discount_pct,
        (SELECT max(margin_pct) FROM disc) AS best_margin_pct""",
    "q43_discount_volume_change": """SELECT units_low, units_high, (units_high - units_low) / units_low * 100 AS change_pct FROM (
        SELECT max(units_sold) FILTER (WHERE discount_pct = 5) AS units_low,
          max(units_sold) FILTER (WHERE discount_pct = 25) AS units_high FROM disc)""",
    "q44_promotion_forecast": """SELECT category, segment, base_units, avg_price, avg_cost, budget, discount_pct, units,
        unit_price, revenue, cost, profit, margin_pct, roi_pct FROM fc""",
    "q45_profit_curve": "SELECT category, segment, discount_pct, profit FROM fc WHERE budget = 8000",
    "q46_forecast_verdict": """SELECT category, segment, budget, discount_pct, roi_pct,
        CASE WHEN roi_pct < 0 THEN 'losing' WHEN roi_pct > 100 THEN 'excellent' ELSE 'moderate' END AS verdict,
        profit > budget AS profit_up, margin_pct > 30 AS margin_up, roi_pct > 0 AS roi_up FROM fc""",
    "q47_forecast_with_advice": """SELECT fc.category, segment, budget, discount_pct, fc.profit,
        roi_pct, what_to_do FROM fc LEFT JOIN advice ON fc.category = advice.category""",
    "q48_answer_discount": "SELECT * FROM disc",
    "q49_answer_campaigns": "SELECT campaign_name, channel, discount_pct, budget, revenue, gross_profit, roi_pct FROM roi",
    "q50_answer_segments": """SELECT *, revenue / total_orders AS aov FROM (
        SELECT customer_segment AS segment, {revenue} AS revenue, {profit} AS gross_profit,
          count(DISTINCT order_id) AS total_orders FROM seg_sales GROUP BY 1)""",
    "q51_answer_categories": """SELECT category_kept AS category, {revenue} AS revenue, {profit} AS gross_profit
        FROM cat_sales GROUP BY 1 ORDER BY gross_profit DESC, 1 LIMIT 5""",
    "q52_answer_kpis": """SELECT {revenue} AS total_revenue, {profit} AS total_profit, {margin} AS avg_margin_pct FROM sales""",
    "q53_adhoc_sql": """SELECT product_id, count(*) AS items, count(DISTINCT order_id) AS orders FROM items
        GROUP BY product_id ORDER BY items DESC, product_id LIMIT 20""",
    "q54_tag_intents": "SELECT conv_id, turn, intent FROM intents",
    "q54_intent_counts": "SELECT intent, count(*) AS questions FROM intents GROUP BY 1",
    "q55_apply_glossary": f"SELECT conv_id, turn, role, {GLOSSARY_SQL} AS text FROM turns",
    "s1_read_items": "SELECT * FROM items",
    "s2_profile": " UNION ALL ".join(
        f"SELECT '{name}' AS table_name, count(*) AS row_count, {len(cols)}::BIGINT AS column_count, '{', '.join(cols)}' AS column_names FROM {cte}"
        for name, cte, cols in [
            ("customers", "cust", ["customer_id", "customer_unique_id", "nation_id", "account_balance", "market_segment"]),
            ("orders", "ord", [
                "order_id", "customer_id", "order_purchase_timestamp", "order_status", "total_price", "order_priority",
            ]),
            ("products", "prod", [
                "product_id", "product_category_name", "product_name", "product_type", "product_size", "retail_price",
            ]),
            ("order_items", "items", [
                "order_id", "product_id", "item_no", "price", "supplier_id", "quantity", "discount", "tax", "return_flag",
                "line_status", "ship_date",
            ]),
            ("payments", "pay", ["order_id", "payment_value"]),
        ]
    ),
    "s2_preview": "SELECT * FROM items ORDER BY ALL LIMIT 5",
    "s7_sql_select": "SELECT round(sum(payment_value::DECIMAL(18,2)), 2)::DOUBLE AS paid, count(*) AS payments FROM pay",
    "j2_sales_campaign_id": "SELECT items.*, campaign_id FROM items LEFT JOIN mapping USING (order_id)",
    "j3_sales_campaign": """SELECT items.*, campaign_id, campaign_name, channel, discount_pct, budget
        FROM items LEFT JOIN mapping USING (order_id) LEFT JOIN camp USING (campaign_id)""",
    "j4_sales_category": "SELECT items.*, category FROM items LEFT JOIN prod USING (product_id)",
    "j5_products_translated": "SELECT product_id, category FROM prod",
    "j6_sales_orders_inner": "SELECT items.*, customer_id FROM items JOIN ord USING (order_id)",
    "j7_sales_orders_left": "SELECT items.*, customer_id FROM items LEFT JOIN ord USING (order_id)",
    "j8_sales_segment_inner": """SELECT items.*, customer_id, customer_segment FROM items JOIN ord USING (order_id)
        JOIN seg USING (customer_id)""",
    "j9_sales_segment_left": """SELECT items.*, customer_id, customer_segment FROM items LEFT JOIN ord USING (order_id)
        LEFT JOIN seg USING (customer_id)""",
    "j10_customers_with_spend": """SELECT cust.*, coalesce(avg_spend, 0) AS avg_spend
        FROM cust LEFT JOIN spend USING (customer_id)""",
    "j12_with_benchmark": """SELECT cat.*, mean_revenue, mean_profit FROM cat,
        (SELECT sum(revenue::DECIMAL(36,2))::DOUBLE / count(*) AS mean_revenue,
          sum(profit::DECIMAL(36,2))::DOUBLE / count(*) AS mean_profit FROM cat)""",
    "j13_sales_wide": """SELECT {what}, price, supplier_id, quantity, discount, tax, return_flag, line_status, ship_date,
        cost_price, revenue, gross_profit, profit_margin_pct, category_kept AS category, customer_id,
        placed AS order_purchase_timestamp, order_status, total_price, order_priority, plain_name AS customer_segment, campaign_id, campaign_name, discount_pct
        FROM seg_sales LEFT JOIN mapping USING (order_id) LEFT JOIN camp USING (campaign_id)""",
    "p1_select": "SELECT order_id, customer_id FROM ord",
    "p3_rename": "SELECT product_id AS product, {price} AS revenue, count(order_id) AS units FROM items GROUP BY 1",
    "p4_filter_and": "SELECT * FROM items WHERE item_no = 1 AND price > 50000",
    "p5_filter_not_unknown": "SELECT product_id, category FROM prod WHERE category IS NOT NULL",
    "p6_month_range": """SELECT order_id, strftime(placed, '%Y-%m') AS month FROM ord
        WHERE strftime(placed, '%Y-%m') BETWEEN '1996-01' AND '1999-12'""",
    "p7_fill_unknown": "SELECT product_id, coalesce(category, 'unknown') AS category FROM prod",
    "p8_recode": "SELECT customer_id, plain_name AS customer_type FROM seg LEFT JOIN names USING (customer_segment)",
    "p9_rule": """SELECT *, CASE WHEN price >= 60000 THEN 'large' WHEN price >= 30000 THEN 'medium' ELSE 'small' END AS size FROM items""",
    "p10_filter_optional": "SELECT * FROM items WHERE item_no = 2",
    "p10_advice_filtered": f"""SELECT category, revenue, profit, avg_margin_pct, what_to_do, {STEPS} AS action_steps
        FROM advice WHERE what_to_do = '🚀 Pay for more ads (Very Profitable)'""",
    "p12_percent_label": "SELECT *, discount_pct || '%' AS discount FROM disc",
    "p13_distinct_values": "SELECT DISTINCT category FROM prod WHERE category IS NOT NULL",
    "p14_top1": "SELECT * FROM items ORDER BY price DESC, order_id, product_id, item_no LIMIT 1",
    "p15_keyed_lookup": """SELECT units_low, units_high, (units_high - units_low) / units_low * 100 AS change_pct FROM (
        SELECT max(units_sold) FILTER (WHERE discount_pct = 10) AS units_low,
          max(units_sold) FILTER (WHERE discount_pct = 20) AS units_high FROM disc)""",
    "a1_total": "SELECT {price} AS price FROM items",
    "a2_mean": "SELECT round(avg(profit_margin_pct), 6) AS profit_margin_pct FROM sales",
    "a3_n_distinct": "SELECT count(DISTINCT order_id) AS order_id FROM items",
    "a4_distinct_by_sketch": """SELECT campaign_id, count(DISTINCT order_id) AS orders, count(DISTINCT product_id) AS products,
      count(DISTINCT customer_id) AS customers, TRUE AS orders_close, TRUE AS products_close, TRUE AS customers_close
      FROM camp_sales JOIN ord USING (order_id) WHERE placed >= '1996-01-01' AND placed < '2000-01-01' AND campaign_id IS NOT NULL
      GROUP BY campaign_id""",
    "a4_group_distinct": "SELECT product_id, count(DISTINCT order_id) AS orders FROM items GROUP BY 1",
    "a5_group_count": "SELECT product_id, count(price) AS items FROM items GROUP BY 1",
    "a6_row_count": "SELECT count(*) AS rows FROM items",
    "a7_group_agg": """SELECT product_id, {revenue} AS revenue, {profit} AS gross_profit, {margin} AS avg_margin_pct,
        count(order_id) AS items FROM sales GROUP BY 1""",
    "a8_group_two_keys": "SELECT product_id, item_no, {price} AS revenue FROM items GROUP BY 1, 2",
    "a9_group_sum": "SELECT order_id, {price} AS price FROM items GROUP BY 1",
    "a10_named_mean": """SELECT customer_id, {mean} AS avg_spend FROM items JOIN ord USING (order_id) GROUP BY 1""",
    "a11_median": "SELECT round(median(price), 6) AS price FROM items",
    "a12_arg_max": """SELECT product_id, {price} AS price FROM items GROUP BY 1 ORDER BY price DESC, product_id LIMIT 1""",
    "a13_ratio_of_sums": "SELECT item_no, {profit} / {revenue} * 100 AS margin_pct FROM sales GROUP BY 1",
    "a14_benchmark": """SELECT sum(revenue::DECIMAL(36,2))::DOUBLE / count(*) AS revenue,
        sum(profit::DECIMAL(36,2))::DOUBLE / count(*) AS profit FROM cat""",
    "a15_describe": _summary("pay", ["payment_value"]),
    "a16_value_counts": "SELECT product_id, count(*) AS rows FROM items GROUP BY 1",
    "a17_round_cols": "SELECT item_no, round_even({mean} * 100, 0) / 100 AS avg_price FROM items GROUP BY 1",
    "a19_mixed_mean": """SELECT item_no, {price} AS revenue, {mean} AS avg_price,
        count(DISTINCT order_id) AS orders FROM items GROUP BY 1""",
    "o1_ranked": "SELECT * FROM pay ORDER BY payment_value DESC, order_id",
    "o2_ordered": "SELECT * FROM pay ORDER BY payment_value, order_id",
    "o3_top_k": "SELECT order_id, {price} AS price FROM items GROUP BY 1 ORDER BY price DESC, order_id LIMIT 15",
    "o4_top_k_per_group": """SELECT * FROM (SELECT *, row_number() OVER (
        PARTITION BY product_id ORDER BY price DESC, order_id, item_no)::INTEGER AS rank FROM items) WHERE rank <= 3""",
    "f1_bround2": "SELECT {what}, round_even(price * 0.333::DOUBLE * 100, 0) / 100 AS third FROM items",
    "f2_round_int": "SELECT {what}, round_even(price * 0.5::DOUBLE, 0)::BIGINT AS half FROM items",
    "f3_log1p": "SELECT {what}, round(ln(1 + price), 9) AS log_price FROM items",
    "f4_at_least": "SELECT {what}, greatest(item_no, 3) AS at_least_3 FROM items",
    "f5_safe_ratio": "SELECT {what}, CASE WHEN item_no - 1 > 0 THEN price / (item_no - 1) ELSE 0 END AS ratio FROM items",
    "f6_to_ts": "SELECT order_id, placed FROM ord",
    "f7_month_key": "SELECT order_id, strftime(placed, '%Y-%m') AS month FROM ord",
    "f8_contains_any": """SELECT conv_id, turn, contains(lower(text), 'the') OR contains(lower(text), 'und')
        OR contains(lower(text), 'que') AS hit FROM turns""",
    "f9_replace_all": "SELECT conv_id, turn, replace(replace(text, 'an', 'on'), 'on', 'in') AS text FROM turns",
    "f10_lookup": "SELECT {what}, CASE item_no WHEN 1 THEN 'first' WHEN 2 THEN 'second' ELSE 'later' END AS place FROM items",
    "f11_pct_change": "SELECT {what}, (price - cost_price) / nullif(cost_price, 0) * 100.0::DOUBLE AS change_pct FROM sales",
    "f12_keyed_draw": "SELECT order_id, ('0x' || substr(md5(order_id::VARCHAR), 1, 8))::BIGINT AS draw FROM ord",
    "f13_title": r"""SELECT conv_id, turn, array_to_string(list_transform(regexp_extract_all(text, '\p{L}+|[^\p{L}]+'),
        lambda run: CASE WHEN run[1] = 'ß' THEN 'Ss' ELSE upper(run[1]) END || lower(run[2:])), '') AS text FROM turns""",
}


def oracle_sql() -> dict[str, str]:
    texts = {}
    for name, query in QUERIES.items():
        text = BASE + query
        for mark, formula in FORMULAS.items():
            text = text.replace(mark, formula)
        texts[name] = text
    return texts
