"""DuckDB SQL for every registered query, written from the metric definitions and not from the Spark plans.

`CTES` hold the shared tables in dependency order; a query gets the ones it refers to.
"""
from __future__ import annotations

import re
from statistics import NormalDist

# The fixed values of the model: labels, plan and rules, which both sides must state alike.
from .operators.audit import CHECKS, PLAN
from .operators.journey import SEGMENTS, STEPS as FUNNEL_STEPS

Z = repr(NormalDist().inv_cdf(0.975))
ZB = repr(NormalDist().inv_cdf(0.8))
JOURNEY = ("view_item", "add_to_cart", "begin_checkout", "add_shipping_info", "add_payment_info", "purchase",
           "view_search_results")
ERFC = ("-1.26551223", "1.00002368", "0.37409196", "0.09678418", "-0.18628806", "0.27886807", "-1.13520398",
        "1.48851587", "-0.82215223", "0.17087277")


def d(x: str) -> str:
    return f"CAST({x} AS DOUBLE)"


def r6(x: str) -> str:
    return f"round({x}, 6)"


def div(a: str, b: str) -> str:
    return f"({d(a)} / NULLIF({d(b)}, 0))"


def big(x: str) -> str:
    return f"CAST(COALESCE({x}, 0) AS BIGINT)"


def cents(x: str) -> str:
    return f"CAST(COALESCE(sum(CAST({x} AS DECIMAL(28,6))), 0) AS DOUBLE)"


def wilson(x: str, n: str) -> tuple[str, str]:
    p, inv = div(x, n), f"(1.0 / NULLIF({d(n)}, 0))"
    scale = f"(1.0 + {Z} * {Z} * {inv})"
    mid = f"(({p} + 0.5 * {Z} * {Z} * {inv}) / {scale})"
    half = f"({Z} * sqrt({p} * (1.0 - {p}) * {inv} + 0.25 * {Z} * {Z} * {inv} * {inv}) / {scale})"
    return tuple(f"CASE WHEN {n} > 0 THEN {e} END" for e in (f"greatest(0.0, {mid} - {half})", f"least(1.0, {mid} + {half})"))


def erfc(x: str) -> str:
    t = f"(1.0 / (1.0 + 0.5 * {x}))"
    poly = ERFC[-1]
    for c in reversed(ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"({t} * exp(-({x}) * ({x}) + {poly}))"


def spread(x1: str, n1: str, x0: str, n0: str) -> str:
    p1, p0 = div(x1, n1), div(x0, n0)
    return f"sqrt({p1} * (1.0 - {p1}) / NULLIF({d(n1)}, 0) + {p0} * (1.0 - {p0}) / NULLIF({d(n0)}, 0))"


def diff(x1: str, n1: str, x0: str, n0: str) -> str:
    return f"({div(x1, n1)} - {div(x0, n0)})"


def zscore(x1: str, n1: str, x0: str, n0: str) -> str:
    """NULL when the pooled error is zero."""
    pool = div(f"({x1} + {x0})", f"({n1} + {n0})")
    err = f"sqrt({pool} * (1.0 - {pool}) * (1.0 / NULLIF({d(n1)}, 0) + 1.0 / NULLIF({d(n0)}, 0)))"
    return f"(abs({diff(x1, n1, x0, n0)}) / NULLIF({err}, 0) / sqrt(2.0))"


def pvalue(z: str, n1: str, n0: str) -> str:
    return f"CASE WHEN {n1} > 0 AND {n0} > 0 THEN COALESCE({erfc(z)}, 1.0) END"


STEP_ROWS = """('view','page_view',0,99,0),('view','view_item',0,99,1),
 ('click','page_view',0,99,0),('click','view_search_results',0,29,1),('click','view_item',20,99,2),('click','add_to_cart',60,99,3),
 ('signup','first_visit',0,99,0),('signup','page_view',0,99,1),('signup','user_engagement',0,99,2),
 ('error','page_view',0,99,0),('error','view_search_results',80,99,1),
 ('purchase','page_view',0,99,0),('purchase','view_item',0,79,1),('purchase','add_to_cart',0,69,2),
 ('purchase','begin_checkout',0,6,3),('purchase','begin_checkout',9,54,3),
 ('purchase','add_shipping_info',0,6,4),('purchase','add_shipping_info',9,54,4),
 ('purchase','add_payment_info',0,34,5),('purchase','purchase',0,24,6),('purchase','purchase',4,6,8)"""

CTES: dict[str, str] = {}

CTES["src"] = """
 SELECT *, dense_rank() OVER (PARTITION BY user_id, user_id % 7 = 3 AND visit_day >= DATE '2024-01-22' ORDER BY visit_day) AS session_number,
        row_number() OVER (PARTITION BY user_id, visit_day ORDER BY ts, event_id) AS nth_of_visit
 FROM (SELECT event_id, user_id, event_type, value, ts, CAST(ts AS DATE) AS day, CAST(ts - INTERVAL 30 MINUTE AS DATE) AS visit_day,
              CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events)"""

CTES["steps"] = f" SELECT * FROM (VALUES {STEP_ROWS}) AS t(event_type, event_name, lo, hi, after)"

CTES["hit"] = """
 SELECT src.*, event_name, after FROM src JOIN steps USING (event_type)
 WHERE k BETWEEN lo AND hi AND NOT (event_name = 'add_payment_info' AND day < DATE '2024-01-05')
 UNION ALL
 SELECT *, 'session_start', -1 FROM src WHERE nth_of_visit = 1 AND k NOT IN (33, 66)
 UNION ALL
 SELECT *, 'session_start', -2 FROM src WHERE nth_of_visit = 1 AND k = 50"""

CTES["shaped"] = """
 SELECT *, (user_id + user_id // 20) % 10 AS m, user_id % 20 AS dv,
        day BETWEEN DATE '2024-01-15' AND DATE '2024-01-21' AND k < 12 AS lost,
        CASE WHEN event_name NOT IN ('view_item','add_to_cart','begin_checkout','purchase') THEN NULL
             WHEN k = 9 THEN 0 WHEN event_name = 'add_to_cart' AND k >= 92 THEN 9 ELSE 1 + k % 4 END AS n_items
 FROM hit"""

CTES["ev"] = """
 SELECT day AS event_date, ts + to_seconds(after) AS event_ts, event_name, CAST(user_id AS VARCHAR) AS user_pseudo_id,
  CASE WHEN event_type = 'view' AND k = 97 THEN NULL ELSE CAST(visit_day - DATE '2024-01-01' + 1 AS BIGINT) END AS ga_session_id,
  session_number AS ga_session_number,
  CASE WHEN event_name = 'page_view' AND k % 50 <> 7 THEN 'https://shop.example/p/' || k END AS page_location,
  CASE WHEN event_name = 'page_view' AND k % 12 <> 0 THEN 'Page ' || k END AS page_title,
  CASE WHEN event_name <> 'view_search_results' OR k % 40 = 5 THEN NULL WHEN k % 10 = 0 THEN '<Other>' ELSE 'term ' || k END AS search_term,
  CASE WHEN event_name = 'user_engagement' THEN 1000 * (k + 1) END AS engagement_time_msec,
  CASE WHEN k % 5 = 0 THEN '0' ELSE '1' END AS session_engaged,
  CASE WHEN event_name = 'session_start' OR user_id % 97 = 5 THEN NULL WHEN dv < 11 THEN 'desktop' WHEN dv < 19 THEN 'mobile' ELSE 'tablet' END AS device_category,
  n_name AS country,
  CASE WHEN m < 4 THEN 'organic' WHEN m < 6 THEN '(none)' WHEN m < 8 THEN 'referral' WHEN m = 8 THEN 'cpc' ELSE '<Other>' END AS first_medium,
  CASE WHEN m < 4 OR m = 8 THEN 'google' WHEN m < 6 THEN '(direct)' WHEN m < 8 THEN 'partner.example' ELSE '<Other>' END AS first_source,
  CASE WHEN event_name <> 'purchase' OR lost OR k = 1 THEN NULL WHEN k = 2 THEN '(not set)' WHEN k = 3 THEN '' WHEN k = 20 THEN 'shared'
       ELSE CAST(event_id AS VARCHAR) END AS transaction_id,
  CASE WHEN event_name = 'purchase' THEN CASE WHEN lost OR k = 3 THEN 0.0 ELSE value END END AS purchase_revenue_usd,
  CAST(n_items AS BIGINT) AS n_items, CAST(n_items AS BIGINT) AS item_quantity, k
 FROM shaped LEFT JOIN nation ON n_nationkey = user_id % 25"""

CTES["it"] = """
 SELECT event_date, event_ts, event_name, user_pseudo_id, ga_session_id, CAST(p_partkey AS VARCHAR) AS item_id, p_name AS item_name,
  p_type AS item_category, p_retailprice AS price_usd, CAST(1 AS BIGINT) AS quantity,
  purchase_revenue_usd / n_items * CASE WHEN k % 10 = 6 THEN 1.2 ELSE 1.0 END AS item_revenue_usd
 FROM (SELECT *, unnest(range(1, n_items + 1)) AS i FROM ev WHERE n_items > 0)
 JOIN part ON p_partkey = (k * 7 + i) % (SELECT count(*) FROM part)"""

CTES["inv"] = """
 SELECT event_name, param_key, count(*) AS n_present, count(v) AS n_nonnull FROM (
  SELECT event_name, 'ga_session_id' AS param_key, CAST(ga_session_id AS VARCHAR) AS v FROM ev WHERE ga_session_id IS NOT NULL
  UNION ALL SELECT event_name, 'ga_session_number', CAST(ga_session_number AS VARCHAR) FROM ev
  UNION ALL SELECT event_name, 'page_location', page_location FROM ev WHERE page_location IS NOT NULL
  UNION ALL SELECT event_name, 'page_title', page_title FROM ev WHERE page_title IS NOT NULL
  UNION ALL SELECT event_name, 'page_title', 'again' FROM ev WHERE event_name = 'page_view' AND k = 13
  UNION ALL SELECT event_name, 'search_term', search_term FROM ev WHERE event_name = 'view_search_results'
  UNION ALL SELECT event_name, 'engagement_time_msec', CAST(engagement_time_msec AS VARCHAR) FROM ev WHERE event_name = 'user_engagement'
  UNION ALL SELECT event_name, 'session_engaged', session_engaged FROM ev)
 GROUP BY ALL"""

CTES["pur"] = """
 SELECT *, has_valid_id AND nth > 1 AS is_repeat, NOT has_valid_id AND NOT has_value AS is_empty,
        CASE WHEN has_valid_id THEN nth = 1 ELSE has_value END AS counts_as_order
 FROM (SELECT user_pseudo_id, ga_session_id, event_ts, event_date, transaction_id, purchase_revenue_usd,
   COALESCE(transaction_id, '') NOT IN ('', '(not set)') AS has_valid_id, COALESCE(purchase_revenue_usd > 0, false) AS has_value,
   row_number() OVER (PARTITION BY user_pseudo_id, transaction_id
     ORDER BY event_ts ASC NULLS LAST, purchase_revenue_usd DESC NULLS LAST, ga_session_id ASC NULLS LAST, event_date) AS nth
  FROM ev WHERE event_name = 'purchase')"""

# What a session is first known by: every known value is a row, and the earliest row of each kind is kept.
CTES["touch"] = """
 SELECT user_pseudo_id, ga_session_id, CAST(max(v) FILTER (kind = 'day') AS DATE) AS session_date, max(v) FILTER (kind = 'device') AS device_category,
  max(v) FILTER (kind = 'country') AS country, max(v) FILTER (kind = 'medium') AS first_medium
 FROM (SELECT *, row_number() OVER (PARTITION BY user_pseudo_id, ga_session_id, kind ORDER BY event_ts, v) AS nth
  FROM (SELECT user_pseudo_id, ga_session_id, event_ts, unnest(['day', 'device', 'country', 'medium']) AS kind,
    unnest([CAST(event_date AS VARCHAR), device_category, country, first_medium]) AS v FROM ev)
  WHERE v IS NOT NULL AND event_ts IS NOT NULL AND ga_session_id IS NOT NULL)
 WHERE nth = 1 GROUP BY user_pseudo_id, ga_session_id"""

# How often a session has each event, as one map.
CTES["seen"] = """
 SELECT user_pseudo_id, ga_session_id, histogram(event_name) AS names, min(event_ts) AS start_ts, min(ga_session_number) AS ga_session_number,
  max(session_engaged) = '1' AS engaged
 FROM ev WHERE ga_session_id IS NOT NULL GROUP BY user_pseudo_id, ga_session_id"""

_TIMES = (("n_session_start", "session_start"), ("page_views", "page_view"), ("searches", "view_search_results"))
_HAS = (("has_view_item", "view_item"), ("has_add_to_cart", "add_to_cart"), ("has_begin_checkout", "begin_checkout"),
        ("has_shipping", "add_shipping_info"), ("has_payment", "add_payment_info"), ("has_purchase_event", "purchase"))
CTES["ses0"] = f"""
 SELECT s.*, session_date, device_category, country, first_medium,
  {', '.join(f"CAST(COALESCE(map_extract(names, '{e}')[1], 0) AS BIGINT) AS {c}" for c, e in _TIMES)},
  {', '.join(f"map_contains(names, '{e}') AS {c}" for c, e in _HAS)}
 FROM seen AS s LEFT JOIN touch USING (user_pseudo_id, ga_session_id)"""

_NESTED = ("f_view_item", "f_add_to_cart", "f_checkout", "f_shipping", "f_payment", "f_purchase")
CTES["ses"] = f"""
 SELECT *, COALESCE(start_ts > min(start_ts) FILTER (WHERE has_purchase) OVER (PARTITION BY user_pseudo_id), false) AS prior_purchaser,
  {', '.join(f"list_bool_and(steps[1:{i + 1}]) AS {c}" for i, c in enumerate(_NESTED))}
 FROM (SELECT *, [has_view_item, has_add_to_cart, has_begin_checkout, has_shipping, has_payment, has_purchase] AS steps
 FROM (
  SELECT ses0.*, CAST(COALESCE(o.n, 0) AS BIGINT) AS orders, COALESCE(o.usd, 0.0) AS revenue_usd, COALESCE(o.n, 0) > 0 AS has_purchase,
   searches > 0 AS has_search, COALESCE(engaged, false) AS is_engaged,
   CASE WHEN ga_session_number = 1 THEN 'new' WHEN ga_session_number IS NOT NULL THEN 'returning' ELSE 'unknown' END AS user_type,
   CASE WHEN first_medium = 'organic' THEN 'organic search' WHEN first_medium = 'cpc' THEN 'paid search'
        WHEN first_medium = 'referral' THEN 'referral' WHEN first_medium = '(none)' THEN 'direct' ELSE 'other or unknown' END AS medium_group
  FROM ses0 LEFT JOIN (
   SELECT user_pseudo_id, ga_session_id, count(*) AS n, CAST(sum(CAST(purchase_revenue_usd AS DECIMAL(28,6))) AS DOUBLE) AS usd
   FROM pur WHERE counts_as_order AND ga_session_id IS NOT NULL GROUP BY 1, 2) AS o USING (user_pseudo_id, ga_session_id)))"""

CTES["tl0"] = f"""
 SELECT s.day AS date, s.sessions, {', '.join(f'COALESCE(e.{e}, 0) AS {e}' for e in JOURNEY)},
  COALESCE(e.purchases_with_id, 0) AS purchases_with_id, COALESCE(e.checkouts_with_items, 0) AS checkouts_with_items
 FROM (SELECT session_date AS day, count(*) AS sessions FROM ses GROUP BY 1) AS s
 LEFT JOIN (SELECT event_date AS day, {', '.join(f"count_if(event_name = '{e}') AS {e}" for e in JOURNEY)},
   count_if(event_name = 'purchase' AND COALESCE(transaction_id, '') NOT IN ('', '(not set)')) AS purchases_with_id,
   count_if(event_name = 'begin_checkout' AND n_items > 0) AS checkouts_with_items FROM ev GROUP BY 1) AS e USING (day)"""

CTES["tl1"] = f"""
 SELECT *, {', '.join(f'median(rate_{e}) OVER () AS typ_{e}' for e in JOURNEY)} FROM (
  SELECT *, {', '.join(f'{d(f"sum({e}) OVER w")} / sum(sessions) OVER w AS rate_{e}' for e in JOURNEY)}
  FROM tl0 WINDOW w AS (ORDER BY date ROWS BETWEEN 2 PRECEDING AND CURRENT ROW))"""

CTES["tl2"] = f" SELECT *, {' AND '.join(f'typ_{e} > 0 AND rate_{e} >= 0.25 * typ_{e}' for e in JOURNEY)} AS ok FROM tl1"

CTES["win"] = """
 SELECT COALESCE(min(date) FILTER (WHERE date > COALESCE((SELECT max(date) FROM tl2 WHERE NOT ok), DATE '0001-01-01')), min(date)) AS start,
  arg_max(ok, date) AS detected FROM tl2"""

CTES["dk"] = f"""
 SELECT s.*, COALESCE(purchase_events, 0) AS purchase_events, COALESCE(purchases_missing_id, 0) AS purchases_missing_id,
  COALESCE(empty_purchase_events, 0) AS empty_purchase_events, COALESCE(repeat_purchase_events, 0) AS repeat_purchase_events,
  COALESCE(orders_without_id, 0) AS orders_without_id, label AS calendar_label,
  {div('purchasing_sessions', 'sessions')} AS conversion, {div('checkout_completed', 'checkout_sessions')} AS checkout_completion,
  {div('search_sessions', 'sessions')} AS search_share, s.date >= (SELECT start FROM win) AS journey_tracked
 FROM (SELECT session_date AS date, count(*) AS sessions, count(DISTINCT user_pseudo_id) AS users,
   count_if(has_purchase) AS purchasing_sessions, {big('sum(orders)')} AS orders, {cents('revenue_usd')} AS revenue_usd,
   count_if(has_search) AS search_sessions, count_if(has_view_item) AS product_view_sessions,
   count_if(has_add_to_cart) AS basket_sessions, count_if(has_begin_checkout) AS checkout_sessions,
   count_if(has_begin_checkout AND has_purchase) AS checkout_completed, count_if(n_session_start = 0) AS sessions_missing_start
  FROM ses GROUP BY 1) AS s
 LEFT JOIN (SELECT event_date AS date, count(*) AS purchase_events, count_if(NOT has_valid_id) AS purchases_missing_id,
   count_if(is_empty) AS empty_purchase_events, count_if(is_repeat) AS repeat_purchase_events,
   count_if(counts_as_order AND NOT has_valid_id) AS orders_without_id FROM pur GROUP BY 1) AS p USING (date)
 LEFT JOIN (VALUES (DATE '2024-01-01', 'New Year''s Day'), (DATE '2024-01-15', 'Holiday Monday'), (DATE '2024-01-26', 'Payday Friday'))
   AS c(date, label) USING (date)"""

WEEK_SUMS = ("sessions", "purchasing_sessions", "orders", "search_sessions", "product_view_sessions", "basket_sessions",
             "checkout_sessions", "checkout_completed", "purchase_events", "purchases_missing_id", "empty_purchase_events",
             "repeat_purchase_events", "orders_without_id", "sessions_missing_start")

CTES["wk"] = f"""
 SELECT CAST(date_trunc('week', date) AS DATE) AS week_start, {', '.join(f'{big(f"sum({c})")} AS {c}' for c in WEEK_SUMS)},
  {cents('revenue_usd')} AS revenue_usd, count(*) AS days, min(date) AS first_day, max(date) AS last_day,
  bool_and(journey_tracked) AS journey_tracked, strftime(date_trunc('week', date), '%G-W%V') AS week
 FROM dk GROUP BY date_trunc('week', date)"""

CTES["gt"] = f"""
 SELECT *, empty_rate > empty_baseline + 0.10 AS held_empty, missing_start_rate > missing_start_baseline + 0.05 AS held_missing_start,
  empty_rate > empty_baseline + 0.10 OR missing_start_rate > missing_start_baseline + 0.05 AS held
 FROM (SELECT week, week_start, empty_rate, COALESCE(median(empty_rate) OVER w, 0) AS empty_baseline, missing_start_rate,
   COALESCE(median(missing_start_rate) OVER w, 0) AS missing_start_baseline
  FROM (SELECT week, week_start, COALESCE({div('empty_purchase_events', 'purchase_events')}, 0) AS empty_rate,
    COALESCE({div('sessions_missing_start', 'sessions')}, 0) AS missing_start_rate FROM wk)
  WINDOW w AS (ORDER BY week_start ROWS BETWEEN 4 PRECEDING AND 1 PRECEDING))"""

CTES["ana"] = """
 SELECT * FROM ses WHERE session_date >= (SELECT start FROM win)
  AND CAST(date_trunc('week', session_date) AS DATE) NOT IN (SELECT week_start FROM gt WHERE held)"""

CTES["tw"] = """
 SELECT * FROM (VALUES ('Opening week', DATE '2024-01-01', DATE '2024-01-07', 'baseline'),
  ('Second week', DATE '2024-01-08', DATE '2024-01-14', 'event'), ('Incident week', DATE '2024-01-15', DATE '2024-01-21', 'event'),
  ('Month end', DATE '2024-01-22', DATE '2024-01-30', 'event'), ('Sizing', DATE '2024-01-08', DATE '2024-01-28', 'sizing'))
  AS t("window", start_date, end_date, role)"""

STEPS = tuple(label for label, _ in FUNNEL_STEPS)
FLAGS = ("true", "f_view_item", "f_add_to_cart", "f_checkout", "f_shipping", "f_payment", "f_purchase")

CTES["fu"] = f"""
 SELECT breakdown, grp AS "group", step_order, step, n AS sessions,
  {d('n')} / first_value(n) OVER w AS rate_from_start, COALESCE({d('n')} / NULLIF(lag(n) OVER w, 0), CASE WHEN step_order = 0 THEN 1.0 END) AS rate_from_previous
 FROM (SELECT breakdown, grp, unnest(range(0, 7)) AS step_order, unnest([{', '.join(f"'{s}'" for s in STEPS)}]) AS step,
    unnest([{', '.join(f'count_if({f})' for f in FLAGS)}]) AS n
  FROM (SELECT *, 'overall' AS breakdown, 'all sessions' AS grp FROM ana UNION ALL SELECT *, 'device', device_category FROM ana
        UNION ALL SELECT *, 'visitor type', user_type FROM ana UNION ALL SELECT *, 'channel', medium_group FROM ana)
  GROUP BY 1, 2)
 WINDOW w AS (PARTITION BY breakdown, grp ORDER BY step_order)"""

CTES["st"] = """
 SELECT device_category, user_type, medium_group, prior_purchaser, count_if(has_search) AS n_search,
  count_if(has_search AND has_purchase) AS x_search, count_if(NOT has_search) AS n_other, count_if(NOT has_search AND has_purchase) AS x_other
 FROM ana WHERE device_category IS NOT NULL GROUP BY 1, 2, 3, 4"""

CTES["adj"] = f"""
 SELECT *, var_root / kept AS se, COALESCE(kept / total, 0) AS coverage FROM (
  SELECT {d("sum(n_search) FILTER (WHERE both_groups)")} AS kept, {d("sum(n_search)")} AS total, count_if(both_groups) AS strata_used,
   count(*) AS strata_total,
   sum(n_search * ({div('x_search', 'n_search')} - {div('x_other', 'n_other')})) FILTER (WHERE both_groups)
     / {d("sum(n_search) FILTER (WHERE both_groups)")} AS diff,
   sqrt(sum({d('n_search')} * n_search * pow({spread('x_search', 'n_search', 'x_other', 'n_other')}, 2)) FILTER (WHERE both_groups)) AS var_root
  FROM (SELECT *, n_search > 0 AND n_other > 0 AS both_groups FROM st))"""

_A = ("x1", "n1", "x0", "n0")
CTES["sv"] = f"""
 SELECT n1 >= 100 AS enough, n1 AS search_sessions, n0 AS other_sessions, {div('n1', '(n1 + n0)')} AS search_share,
  CASE WHEN n1 > 0 AND n0 > 0 THEN {div('x1', 'n1')} END AS conversion_search, CASE WHEN n1 > 0 AND n0 > 0 THEN {div('x0', 'n0')} END AS conversion_other,
  {diff(*_A)} AS naive_diff, {diff(*_A)} - {Z} * {spread(*_A)} AS naive_lo, {diff(*_A)} + {Z} * {spread(*_A)} AS naive_hi,
  {pvalue('zs', 'n1', 'n0')} AS naive_p_value, {diff(*_A)} / NULLIF({div('x0', 'n0')}, 0) AS naive_rel,
  diff AS adjusted_diff, se AS adjusted_se, diff - {Z} * se AS adjusted_lo, diff + {Z} * se AS adjusted_hi, coverage, strata_used, strata_total,
  1 - diff / NULLIF({diff(*_A)}, 0) AS share_explained, product_view_rate_search, product_view_rate_other
 FROM (SELECT *, {zscore(*_A)} AS zs FROM (SELECT {big('sum(n_search)')} AS n1, {big('sum(x_search)')} AS x1,
   {big('sum(n_other)')} AS n0, {big('sum(x_other)')} AS x0 FROM st)), adj,
  (SELECT {div('count_if(has_search AND has_view_item)', 'count_if(has_search)')} AS product_view_rate_search,
   {div('count_if(NOT has_search AND has_view_item)', 'count_if(NOT has_search)')} AS product_view_rate_other FROM ana)"""

CTES["uw"] = """
 SELECT wk, user_pseudo_id, max(searched) = 1 AS s, max(bought) = 1 AS b, max(searched * viewed) = 1 AS v
 FROM (SELECT date_trunc('week', session_date) AS wk, user_pseudo_id, CAST(has_search AS INT) AS searched, CAST(has_purchase AS INT) AS bought,
   CAST(has_view_item AS INT) AS viewed
  FROM ana JOIN (SELECT DISTINCT CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS sized FROM tw WHERE role = 'sizing')
   ON session_date = sized)
 GROUP BY ALL"""

CTES["xs"] = f"""
 SELECT *, CAST(ceil(pow({Z} * sqrt(2 * (baseline + p1) / 2 * (1 - (baseline + p1) / 2))
    + {ZB} * sqrt(baseline * (1 - baseline) + p1 * (1 - p1)), 2) / pow(p1 - baseline, 2)) AS BIGINT) AS users_per_arm
 FROM (SELECT *, baseline * (1 + relative_lift) AS p1 FROM (
   SELECT sizing_weeks, searchers, buyers, {div('searchers', 'sizing_weeks')} AS weekly_searching_users,
    m.metric_order, m.metric, {div('CASE WHEN m.metric_order = 0 THEN buyers ELSE viewers END', 'searchers')} AS baseline, l.relative_lift
   FROM (SELECT count_if(s) AS searchers, count_if(s AND b) AS buyers, count_if(v) AS viewers, count(DISTINCT wk) AS sizing_weeks FROM uw)
   CROSS JOIN (VALUES (0, 'Bought within the week'), (1, 'Saw products in a search session')) AS m(metric_order, metric)
   CROSS JOIN (VALUES ({d('0.05')}), ({d('0.10')}), ({d('0.20')})) AS l(relative_lift)
   WHERE searchers > 0 AND buyers > 0))
 WHERE p1 > 0 AND p1 < 1"""

CTES["xw"] = f" SELECT *, CAST(ceil({div('2 * users_per_arm', 'weekly_searching_users')}) AS BIGINT) AS weeks FROM xs"

CTES["cd"] = """
 SELECT device_category, count(*) AS began_checkout, count_if(has_shipping) AS added_delivery, count_if(has_payment) AS added_payment,
  count_if(has_purchase) AS purchased FROM ana WHERE has_begin_checkout GROUP BY 1"""

_M = ("m.purchased", "m.began_checkout", "t.purchased", "t.began_checkout")
CTES["md"] = f"""
 SELECT x1 / n1 AS mobile, x0 / n0 AS desktop, CAST(n1 AS BIGINT) AS mobile_n, CAST(n0 AS BIGINT) AS desktop_n, {diff(*_A)} AS diff,
  {diff(*_A)} - {Z} * {spread(*_A)} AS lo, {diff(*_A)} + {Z} * {spread(*_A)} AS hi, {pvalue('zs', 'n1', 'n0')} AS p_value,
  {diff(*_A)} / NULLIF(x0 / n0, 0) AS rel
 FROM (SELECT *, {zscore(*_A)} AS zs FROM (SELECT {d(_M[0])} AS x1, {d(_M[1])} AS n1, {d(_M[2])} AS x0, {d(_M[3])} AS n0
  FROM cd AS m, cd AS t WHERE m.device_category = 'mobile' AND t.device_category = 'desktop'))"""

# Each purchase with its own item lines, added up per purchase.
CTES["pairs"] = """
 SELECT order_usd, items_usd, order_usd - items_usd AS over, greatest(abs(items_usd), 0.01) / 100 AS allowed
 FROM (SELECT any_value(sent.purchase_revenue_usd) AS order_usd, CAST(sum(CAST(line.item_revenue_usd AS DECIMAL(18,6))) AS DOUBLE) AS items_usd
  FROM (SELECT *, row_number() OVER () AS sale FROM pur WHERE purchase_revenue_usd IS NOT NULL) AS sent
  JOIN it AS line ON line.event_name = 'purchase' AND line.item_revenue_usd IS NOT NULL AND line.user_pseudo_id = sent.user_pseudo_id
   AND line.ga_session_id = sent.ga_session_id AND line.event_ts = sent.event_ts
  GROUP BY sale)"""

# The median as the mean of the one or two middle ranks.
CTES["rg"] = """
 SELECT count(*) FILTER (side = 0) AS "match", count(*) FILTER (side = 1) AS above, count(*) FILTER (side = -1) AS below,
  (SELECT avg(rel) FROM (SELECT rel, row_number() OVER (ORDER BY rel) AS nth, count(*) OVER () AS many FROM
     (SELECT abs(over) / NULLIF(abs(items_usd), 0) AS rel FROM pairs WHERE abs(over) > allowed) WHERE rel IS NOT NULL)
   WHERE nth IN ((many + 1) // 2, (many + 2) // 2)) AS median_gap
 FROM (SELECT CASE WHEN abs(over) <= allowed THEN 0 ELSE sign(over) END AS side FROM pairs)"""

PLAN_ROWS = ", ".join(f"({i}, '{stage}', '{event}', '{field}', '{source}')" for i, (event, stage, field, source, _) in enumerate(PLAN))

CTES["cov"] = f"""
 SELECT *, {div('n_ok', 'n_events')} AS coverage, 0.95 AS target, CASE WHEN n_events = 0 THEN 'not tracked'
  WHEN {div('n_ok', 'n_events')} >= 0.95 THEN 'pass' ELSE 'fail' END AS status
 FROM (SELECT p.*, {big('''CASE WHEN source = 'event_param' THEN (SELECT sum(n_nonnull) FROM inv WHERE inv.event_name = p.event AND inv.param_key = p.field)
    WHEN source = 'items' THEN (SELECT count(*) FROM ev WHERE ev.event_name = p.event AND n_items > 0)
    WHEN field = 'transaction_id' THEN (SELECT count(*) FROM pur WHERE has_valid_id)
    ELSE (SELECT count(*) FROM pur WHERE purchase_revenue_usd > 0) END''')} AS n_ok,
   {big('(SELECT count(*) FROM ev WHERE ev.event_name = p.event)')} AS n_events
  FROM (VALUES {PLAN_ROWS}) AS p(plan_order, stage, event, field, source))"""

_EC = "event_name IN ('view_item', 'add_to_cart', 'begin_checkout', 'purchase')"
# What each check of the fixed list counts: table, what is faulty, out of what.
_COUNTS = (
    ("ev", "ga_session_id IS NULL", "true"), ("ses", "n_session_start = 0", "true"), ("ses", "n_session_start > 1", "true"),
    ("pur", "NOT has_valid_id", "true"), ("pur", "is_repeat", "true"), ("pur", "NOT has_value", "true"),
    ("ev", "COALESCE(n_items, 0) = 0", _EC), ("ev", "n_items > 5", "event_name = 'add_to_cart'"),
    ("ses", "NOT has_begin_checkout", "has_purchase"), ("ev", "COALESCE(search_term, '') = ''", "event_name = 'view_search_results'"),
    ("ev", "search_term IN ('<Other>', '(not set)', '(data deleted)', '<obfuscated>')", "event_name = 'view_search_results'"),
    ("ev", "COALESCE(page_location, '') = ''", "event_name = 'page_view'"), ("pairs", "abs(over) > allowed", "true"),
    ("cov", "status <> 'pass'", "true"),
)
_CHECKS = tuple((*fixed[:4], "NULL" if fixed[4] is None else str(fixed[4]), *counts) for fixed, counts in zip(CHECKS, _COUNTS, strict=True))


def _check(i: int, row: tuple) -> str:
    check, question, owner, severity, threshold, table, fault, scope = row
    question = question.replace("'", "''")
    return (f"SELECT {i} AS check_order, '{check}' AS \"check\", '{question}' AS question, '{owner}' AS owner, '{severity}' AS severity, "
            f"count_if(({fault}) AND ({scope})) AS numerator, count_if({scope}) AS denominator, {d(threshold)} AS threshold FROM {table}")


CTES["card"] = f"""
 SELECT *, {div('numerator', 'denominator')} AS rate, CASE WHEN denominator = 0 THEN 'n/a' WHEN threshold IS NULL THEN 'info'
  WHEN {div('numerator', 'denominator')} > threshold THEN 'fail' ELSE 'pass' END AS status
 FROM ({' UNION ALL '.join(_check(i, row) for i, row in enumerate(_CHECKS))})"""


def _overview(table: str) -> str:
    lo, hi = wilson("purchasing_sessions", "sessions")
    return f"""
 SELECT first_day, last_day, events, sessions, users, purchasing_sessions, orders, revenue_usd,
  {div('purchasing_sessions', 'sessions')} AS conversion, {lo} AS conversion_lo, {hi} AS conversion_hi,
  {div('revenue_usd', 'orders')} AS revenue_per_order, {div('searching', 'sessions')} AS search_share, {div('engaged', 'sessions')} AS engaged_share
 FROM (SELECT min(session_date) AS first_day, max(session_date) AS last_day, (SELECT count(*) FROM ev) AS events, count(*) AS sessions,
  count(DISTINCT user_pseudo_id) AS users, count_if(has_purchase) AS purchasing_sessions, {big('sum(orders)')} AS orders,
  {cents('revenue_usd')} AS revenue_usd, count_if(has_search) AS searching, count_if(is_engaged) AS engaged FROM {table})"""


CTES["ov"] = _overview("ses")
CTES["ovw"] = _overview("ana")
CTES["os"] = f"""
 SELECT p.*, c.* FROM (SELECT count(*) AS purchase_events, count_if(is_repeat) AS repeats, count_if(is_empty) AS empty,
   count_if(counts_as_order) AS orders, count_if(counts_as_order AND NOT has_valid_id) AS orders_without_id FROM pur) AS p,
  (SELECT {div('count_if(has_purchase)', 'count(*)')} AS conversion_orders,
   {div('count_if(has_purchase_event)', 'count(*)')} AS conversion_raw_events FROM ana) AS c"""
CTES["asum"] = """
 SELECT start, detected, (SELECT min(session_date) FROM ana) AS first_day, (SELECT max(session_date) FROM ana) AS last_day,
  (SELECT count(*) FROM ana) AS sessions, COALESCE((SELECT string_agg(week, ', ' ORDER BY week) FROM gt WHERE held), '') AS excluded_weeks FROM win"""
CTES["bd"] = """
 SELECT b.step AS from_step, a.step AS to_step, a.rate_from_previous AS kept, b.sessions AS sessions_before, a.sessions AS sessions_after
 FROM fu AS a JOIN fu AS b ON b.step_order = a.step_order - 1
 WHERE a.breakdown = 'overall' AND b.breakdown = 'overall' AND a.rate_from_previous IS NOT NULL
 ORDER BY a.rate_from_previous, a.step_order LIMIT 1"""


def mix(column: str) -> str:
    return f"""SELECT {column} AS "group", count(*) AS sessions, {r6(d('count(*)') + ' / (SELECT count(*) FROM ana)')} AS share
 FROM ana GROUP BY 1 ORDER BY 2 DESC, 1 ASC NULLS LAST LIMIT 5"""


def pick(table: str, plain: str, rounded: str, tail: str = "") -> str:
    cols = [f'"{c}"' for c in plain.split()] + [f'{r6(c)} AS "{c}"' for c in rounded.split()]
    return f"SELECT {', '.join(cols)} FROM {table} {tail}"


EVENT_COLS = ("event_date event_ts event_name user_pseudo_id ga_session_id ga_session_number page_location page_title search_term "
              "engagement_time_msec session_engaged device_category country first_medium first_source transaction_id n_items item_quantity")
SESSION_COLS = ("user_pseudo_id ga_session_id start_ts session_date device_category country first_medium ga_session_number n_session_start "
                "page_views searches engaged has_view_item has_add_to_cart has_begin_checkout has_shipping has_payment has_purchase_event "
                "orders has_purchase has_search is_engaged user_type medium_group f_view_item f_add_to_cart f_checkout f_shipping f_payment "
                "f_purchase prior_purchaser")
OVERVIEW = ("first_day last_day events sessions users purchasing_sessions orders",
            "revenue_usd conversion conversion_lo conversion_hi revenue_per_order search_share engaged_share")
_lo, _hi = wilson("purchased", "began_checkout")
_slo, _shi = wilson("x", "n")


def _segment(i: int, name: str, rule: str) -> str:
    text = rule.replace("'", "''")
    return (f"SELECT {i} AS segment_order, '{name}' AS segment, '{text}' AS definition, count(*) AS n, count(*) FILTER (WHERE has_purchase) AS x, "
            f"{cents('revenue_usd')} AS usd FROM ana WHERE {rule}")


_W = ("a.purchasing_sessions", "a.sessions", "b.purchasing_sessions", "b.sessions")
_C = ("a.checkout_completed", "a.checkout_sessions", "b.checkout_completed", "b.checkout_sessions")
_IN = "a.start_date >= (SELECT start FROM win)"
_WSUM = ("sessions", "purchasing_sessions", "orders", "orders_without_id", "checkout_sessions", "checkout_completed", "search_sessions")
CTES["wa"] = f"""
 SELECT "window", role, start_date, end_date, count_if(used) AS days, count_if(NOT used) AS days_excluded,
  {', '.join(f'{big(f"sum({c}) FILTER (WHERE used)")} AS {c}' for c in _WSUM)}, {cents('CASE WHEN used THEN revenue_usd END')} AS usd
 FROM (SELECT *, row_number() OVER () AS number FROM tw) LEFT JOIN (SELECT *, CAST(date_trunc('week', date) AS DATE) NOT IN (SELECT week_start FROM gt WHERE held) AS used FROM dk) AS y
  ON y.date BETWEEN start_date AND end_date
 WHERE role IN ('baseline', 'event') GROUP BY 1, 2, 3, 4, number"""
CTES["wz"] = f"""
 SELECT a.*, {diff(*_W)} AS cd, {zscore(*_W)} AS cz, {div('b.purchasing_sessions', 'b.sessions')} AS cb, b.sessions AS bn,
  {diff(*_C)} AS kd, {zscore(*_C)} AS kz, b.checkout_sessions AS bk
 FROM wa AS a, (SELECT * FROM wa WHERE role = 'baseline' ORDER BY start_date LIMIT 1) AS b"""

_REPORT = (("Sessions", d("sessions"), "relative"), ("Session conversion", div("purchasing_sessions", "sessions"), "points"),
           ("Orders", d("orders"), "relative"), ("Revenue (USD)", "revenue_usd", "relative"),
           ("Revenue per order", div("revenue_usd", "orders"), "relative"),
           ("Sessions using search", div("search_sessions", "sessions"), "points"),
           ("Sessions viewing products", div("product_view_sessions", "sessions"), "points"),
           ("Sessions adding to basket", div("basket_sessions", "sessions"), "points"),
           ("Checkout completion", div("checkout_completed", "checkout_sessions"), "points"))
CTES["wr"] = f"""
 SELECT week, held, days, metric_order, metric, current, change_kind, purchasing_sessions AS x1, sessions AS n1,
  lag(week) OVER w AS previous_week, lag(current) OVER w AS previous, lag(purchasing_sessions) OVER w AS x0, lag(sessions) OVER w AS n0
 FROM ({' UNION ALL '.join(f"SELECT *, {i} AS metric_order, '{n}' AS metric, {v} AS current, '{k}' AS change_kind FROM wk" for i, (n, v, k) in enumerate(_REPORT))})
 JOIN (SELECT week, held FROM gt) USING (week) WINDOW w AS (PARTITION BY metric_order ORDER BY week_start)"""
_rlo, _rhi = wilson("x1", "n1")

QUERIES: dict[str, str] = {
    "repeated_params": f"SELECT event_name, {big("count_if(event_name = 'page_view' AND k = 13)")} AS n_events_with_repeated_keys FROM ev GROUP BY 1",
    "flatten_events": pick("ev", EVENT_COLS, "purchase_revenue_usd"),
    "flatten_items": pick("it", "event_date event_ts event_name user_pseudo_id ga_session_id item_id item_name item_category quantity",
                          "price_usd item_revenue_usd"),
    "param_inventory": "SELECT event_name, param_key, n_present, n_nonnull FROM inv",
    "orders_flags": pick("pur", "user_pseudo_id ga_session_id event_ts event_date transaction_id has_valid_id is_repeat is_empty "
                         "counts_as_order", "purchase_revenue_usd"),
    "order_summary": pick("os", "purchase_events repeats empty orders orders_without_id", "conversion_orders conversion_raw_events"),
    "sessions": pick("ses", SESSION_COLS, "revenue_usd"),
    "prior_purchaser": """SELECT s.user_pseudo_id, s.ga_session_id, EXISTS (SELECT 1 FROM ses AS e
  WHERE e.user_pseudo_id = s.user_pseudo_id AND e.has_purchase AND e.start_ts < s.start_ts) AS prior_purchaser FROM ses AS s""",
    "session_cells": f"""SELECT session_date, device_category, user_type, medium_group, prior_purchaser, has_search, is_engaged, {', '.join(c for c, _ in _HAS)},
  has_purchase, least(n_session_start, 2) AS n_session_start, {', '.join(_NESTED)}, count(*) AS n_sessions, {big('sum(orders)')} AS orders,
  {r6(cents('revenue_usd'))} AS revenue_usd FROM ses GROUP BY ALL""",
    "users_by_day": "SELECT session_date AS date, count(DISTINCT user_pseudo_id) AS users FROM ses GROUP BY 1",
    "users_by_week": """SELECT CAST(date_trunc('week', session_date) AS DATE) AS week_start, count(DISTINCT user_pseudo_id) AS users,
  count(DISTINCT session_date) AS days FROM ses GROUP BY 1""",
    "overview": pick("ov", *OVERVIEW),
    "window_overview": pick("ovw", *OVERVIEW),
    "device_mix": mix("device_category"),
    "country_mix": mix("country"),
    "channel_mix": mix("medium_group"),
    "tracking_timeline": f"""SELECT date, sessions, {', '.join(JOURNEY)}, purchases_with_id, checkouts_with_items,
  {', '.join(f"{r6(div(f'100 * {e}', 'sessions'))} AS {e}_per_100_sessions" for e in JOURNEY)},
  ok AS all_journey_events_tracked, date >= (SELECT start FROM win) AS in_journey_window FROM tl2""",
    "journey_window": "SELECT start, detected FROM win",
    "analysis_sessions_summary": "SELECT * FROM asum",
    "weekly_tracking_completeness": f"""SELECT week_start, {r6(div('100 * sum(purchases_with_id)', 'sum(purchase)'))} AS pct_purchases_with_id,
  {r6(div('100 * sum(checkouts_with_items)', 'sum(begin_checkout)'))} AS pct_checkouts_with_items,
  {r6(div('100 * sum(add_to_cart)', 'sum(sessions)'))} AS add_to_cart_per_100_sessions,
  {r6(div('100 * sum(view_search_results)', 'sum(sessions)'))} AS searches_per_100_sessions
 FROM (SELECT *, greatest(CAST(date_trunc('week', date) AS DATE), (SELECT min(date) FROM tl0)) AS week_start FROM tl0) GROUP BY 1""",
    "daily_kpis": pick("dk", "date sessions users purchasing_sessions orders search_sessions product_view_sessions basket_sessions "
                       "checkout_sessions checkout_completed sessions_missing_start purchase_events purchases_missing_id "
                       "empty_purchase_events repeat_purchase_events orders_without_id calendar_label journey_tracked",
                       "revenue_usd conversion checkout_completion search_share"),
    "conversion_trend": f"""SELECT date, {r6('conversion')} AS conversion, calendar_label,
  {r6('CASE WHEN count(conversion) OVER w >= 4 THEN avg(conversion) OVER w END')} AS conversion_7_day
 FROM dk WINDOW w AS (ORDER BY date ROWS BETWEEN 6 PRECEDING AND CURRENT ROW)""",
    "weekly_kpis": pick("wk", "week week_start days first_day last_day journey_tracked " + " ".join(WEEK_SUMS), "revenue_usd"),
    "weekly_gate": pick("gt", "week week_start held_empty held_missing_start held",
                        "empty_rate empty_baseline missing_start_rate missing_start_baseline"),
    "held_weeks": "SELECT week FROM gt WHERE held",
    "weekly_notes": """SELECT week, held, NULLIF(orders_without_id, 0) AS orders_without_id, NULLIF(repeat_purchase_events, 0) AS repeats_removed,
  CASE WHEN NOT held THEN NULLIF(empty_purchase_events, 0) END AS empty_events_not_counted, NOT journey_tracked AS journey_not_fully_tracked
 FROM wk JOIN (SELECT week, held FROM gt) USING (week)""",
    "latest_full_week": "SELECT week FROM wk ORDER BY days = 7 DESC, week_start DESC LIMIT 1",
    "weekly_report": f"""SELECT week, previous_week, held, days, metric_order, metric, {r6('current')} AS current, {r6('previous')} AS previous,
  {r6("CASE WHEN change_kind = 'points' THEN current - previous ELSE (current - previous) / NULLIF(previous, 0) END")} AS change, change_kind,
  {r6(f"CASE WHEN metric = 'Session conversion' THEN {_rlo} END")} AS interval_lo,
  {r6(f"CASE WHEN metric = 'Session conversion' THEN {_rhi} END")} AS interval_hi,
  CASE WHEN metric = 'Session conversion' THEN {pvalue('zs', 'n1', 'n0')} < 0.05 END AS significant
 FROM (SELECT *, {zscore(*_A)} AS zs FROM wr)""",
    "funnel": pick("fu", "breakdown group step_order step sessions", "rate_from_start rate_from_previous"),
    "biggest_drop": pick("bd", "from_step to_step sessions_before sessions_after", "kept"),
    "funnel_automatic_steps": """SELECT b.step AS from_step, a.step AS to_step, b.sessions FROM fu AS a JOIN fu AS b ON b.step_order = a.step_order - 1
 WHERE a.breakdown = 'overall' AND b.breakdown = 'overall' AND b.step_order >= 1 AND b.sessions >= 100 AND a.sessions = b.sessions""",
    "untracked_orders": f"""SELECT n AS ordering_sessions, f AS funnel_sessions, n - f AS missing_a_step, {r6(div('n - f', 'n'))} AS share_missing
 FROM (SELECT count_if(has_purchase) AS n, count_if(f_purchase) AS f FROM ana)""",
    "search_strata": "SELECT * FROM st",
    "search_vs_intent": pick("sv", "enough search_sessions other_sessions strata_used strata_total",
                             "search_share conversion_search conversion_other naive_diff naive_lo naive_hi naive_p_value naive_rel adjusted_diff "
                             "adjusted_se adjusted_lo adjusted_hi coverage share_explained product_view_rate_search product_view_rate_other"),
    "search_verdict": f"""SELECT CASE WHEN NOT enough THEN 'too few searches' WHEN adjusted_lo <= 0 AND adjusted_hi >= 0 THEN 'indistinguishable from zero'
   WHEN adjusted_diff > 0 THEN 'positive difference remains' ELSE 'negative difference' END AS verdict, explained, {r6('share_explained')} AS share_explained,
  CASE WHEN explained = 'none' THEN CASE WHEN adjusted_diff > naive_diff THEN 'slightly larger' ELSE 'about the same' END END AS like_for_like_gap
 FROM (SELECT *, CASE WHEN NOT enough OR share_explained IS NULL OR naive_diff <= 0 THEN NULL WHEN share_explained >= 1 THEN 'all'
   WHEN share_explained <= 0.05 THEN 'none' ELSE 'part' END AS explained FROM sv)""",
    "experiment_sizing": pick("xw", "sizing_weeks searchers buyers metric_order metric relative_lift users_per_arm weeks",
                              "weekly_searching_users baseline"),
    "primary_metric": """SELECT *, CASE WHEN weeks_saw_products < weeks_bought THEN 'Saw products in a search session'
  WHEN weeks_bought IS NOT NULL THEN 'Bought within the week' END AS primary_metric
 FROM (SELECT max(weeks) FILTER (WHERE metric_order = 0) AS weeks_bought, max(weeks) FILTER (WHERE metric_order = 1) AS weeks_saw_products
  FROM xw WHERE abs(relative_lift - 0.1) < 1e-9)""",
    "checkout_by_device": f"""SELECT device_category, began_checkout, added_delivery, added_payment, purchased,
  {r6(div('added_delivery', 'began_checkout'))} AS added_delivery_rate, {r6(div('added_payment', 'began_checkout'))} AS added_payment_rate,
  {r6(div('purchased', 'began_checkout'))} AS purchased_rate, {r6(_lo)} AS completion_lo, {r6(_hi)} AS completion_hi FROM cd""",
    "checkout_mobile_vs_desktop": pick("md", "mobile_n desktop_n", "mobile desktop diff lo hi p_value rel"),
    "segments": f"""SELECT segment_order, segment, definition, n AS sessions, {r6(div('n', '(SELECT count(*) FROM ana)'))} AS share_of_sessions,
  x AS purchasing_sessions, {r6(div('x', 'n'))} AS conversion, {r6(_slo)} AS conversion_lo, {r6(_shi)} AS conversion_hi, {r6('usd')} AS revenue_usd,
  {r6(div('usd', 'n'))} AS revenue_per_session FROM ({' UNION ALL '.join(_segment(i, *s) for i, s in enumerate(SEGMENTS))})""",
    "trading_windows": f"""SELECT "window", role, start_date AS "start", end_date AS "end", days, days_excluded,
  {r6(div('sessions', 'days'))} AS sessions_per_day, CASE WHEN bn > 0 THEN {r6(div('purchasing_sessions', 'sessions'))} END AS conversion,
  {r6('cd')} AS conversion_change_pp, {r6('cd / NULLIF(cb, 0)')} AS conversion_change_rel, {r6(pvalue('cz', 'sessions', 'bn'))} AS conversion_p_value,
  {r6(div('usd', 'orders'))} AS revenue_per_order, {r6(div('orders_without_id', 'orders'))} AS share_orders_without_id,
  CASE WHEN {_IN} AND bk > 0 THEN {r6(div('checkout_completed', 'checkout_sessions'))} END AS checkout_completion,
  CASE WHEN {_IN} THEN {r6('kd')} END AS checkout_completion_change_pp,
  CASE WHEN {_IN} THEN {r6(pvalue('kz', 'checkout_sessions', 'bk'))} END AS checkout_completion_p_value,
  {r6(div('search_sessions', 'sessions'))} AS search_share FROM wz AS a""",
    "audit_scorecard": pick("card", "check_order check question owner severity numerator denominator threshold status", "rate"),
    "audit_failures": pick("(SELECT *, CASE severity WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS severity_rank FROM card)",
                           "severity_rank check_order check severity owner numerator denominator threshold", "rate", "WHERE status = 'fail'"),
    "tracking_coverage": f"SELECT plan_order, stage, event, field, source, n_ok, n_events, {r6('coverage')} AS coverage, {d('target')} AS target, status FROM cov",
    "revenue_gap": pick("rg", "match above below", "median_gap"),
    "revenue_gap_verdict": f"""SELECT "match" + above + below AS comparable, above + below AS mismatches, {r6(div('above', 'above + below'))} AS share_above,
  CASE WHEN above + below = 0 THEN 'all match' WHEN {div('above', 'above + below')} BETWEEN 0.35 AND 0.65 THEN 'noise' ELSE 'one-sided' END AS verdict FROM rg""",
    "okr_targets": f"""SELECT {r6('sees')} AS search_sees_products, {r6('least(sees * 1.1, 0.99)')} AS search_sees_products_target,
  {r6('basket')} AS view_to_basket, {r6('least(basket * 1.1, 0.99)')} AS view_to_basket_target, {r6('mobile')} AS mobile_completion,
  {r6('desktop')} AS desktop_completion, {r6('greatest(mobile, (mobile + desktop) / 2)')} AS mobile_completion_target,
  {r6('1 - missing')} AS valid_id_share, {d('0.995')} AS valid_id_target, {r6('conversion')} AS conversion, {r6('engaged_share')} AS engaged_share, high_severity_failures
 FROM (SELECT (SELECT product_view_rate_search FROM sv) AS sees, (SELECT rate_from_previous FROM fu WHERE breakdown = 'overall' AND step_order = 2) AS basket,
  (SELECT mobile FROM md) AS mobile, (SELECT desktop FROM md) AS desktop,
  (SELECT rate FROM card WHERE "check" = 'purchases_missing_transaction_id') AS missing, conversion, engaged_share,
  (SELECT count(*) FROM card WHERE status = 'fail' AND severity = 'high') AS high_severity_failures FROM ovw)""",
    "headline": f"""SELECT ov.sessions, ov.users, ov.first_day, ov.last_day, asum.start AS window_start, asum.sessions AS window_sessions, asum.excluded_weeks,
  os.purchase_events, os.orders, os.repeats, os.empty AS empty_events, (SELECT count_if(status = 'fail') FROM card) AS checks_failed,
  (SELECT count(*) FROM card) AS checks, {r6('ovw.conversion')} AS conversion, {r6('ovw.conversion_lo')} AS conversion_lo, {r6('ovw.conversion_hi')} AS conversion_hi,
  bd.from_step AS drop_from, bd.to_step AS drop_to, {r6('bd.kept')} AS drop_kept, {r6('sv.search_share')} AS search_share,
  {r6('sv.naive_diff')} AS search_naive_diff, {r6('sv.adjusted_diff')} AS search_adjusted_diff, {r6('sv.adjusted_lo')} AS search_adjusted_lo,
  {r6('sv.adjusted_hi')} AS search_adjusted_hi, {r6('md.mobile')} AS mobile_completion, {r6('md.desktop')} AS desktop_completion, {r6('md.diff')} AS completion_diff
 FROM ov, asum, os, ovw, sv LEFT JOIN bd ON true LEFT JOIN md ON true""",
}

QUERIES["ordered_before"] = QUERIES["prior_purchaser"]
QUERIES["sessions_by_state"] = QUERIES["sessions"]
QUERIES["schema_drift"] = """SELECT DISTINCT event_date, CASE third WHEN 1 THEN 'country' ELSE 'n_items' END AS "column",
  CASE third WHEN 1 THEN 'missing' ELSE 'is string' END AS fault, 1 AS files
 FROM (SELECT event_date, (event_date - DATE '1970-01-01') % 3 AS third FROM ev) WHERE third > 0"""
QUERIES["stored_event_profile"] = """SELECT event_date AS date, event_name, count(*) AS n, count(*) FILTER (WHERE ga_session_id IS NULL) AS no_session,
  count(*) FILTER (WHERE n_items > 0) AS with_items, count(*) FILTER (WHERE n_items > 5) AS many_items, count(*) FILTER (WHERE COALESCE(transaction_id, '') NOT IN ('', '(not set)')) AS with_id,
  count(*) FILTER (WHERE purchase_revenue_usd > 0) AS with_revenue, count(*) FILTER (WHERE COALESCE(search_term, '') = '') AS no_term,
  count(*) FILTER (WHERE search_term IN ('<Other>', '(not set)', '(data deleted)', '<obfuscated>')) AS placeholder_term,
  count(*) FILTER (WHERE COALESCE(page_location, '') = '') AS no_location FROM ev GROUP BY ALL"""
QUERIES["analysis_event_counts"] = """SELECT event_name, count(*) AS events, count(DISTINCT event_date) AS days, count(*) FILTER (WHERE ga_session_id IS NULL) AS no_session
 FROM ev WHERE event_date IN (SELECT date FROM dk WHERE journey_tracked)
  AND CAST(date_trunc('week', event_date) AS DATE) NOT IN (SELECT week_start FROM gt WHERE held) GROUP BY 1"""


def _object(query: str) -> str:
    return f"(SELECT to_json(t) FROM ({query}) AS t)"


def _list(query: str, order: str) -> str:
    return f"(SELECT to_json(list(t ORDER BY {order})) FROM ({query}) AS t)"


def _described(totals: str, table: str) -> str:
    mixes = ", ".join(f"{name}_mix := " + _list(mix(column).replace("FROM ana", f"FROM {table}"), 'sessions DESC, "group"')
                      for name, column in (("device", "device_category"), ("country", "country"), ("channel", "medium_group")))
    return f"struct_pack(totals := {_object(QUERIES[totals])}, {mixes})"


_DOCUMENT = {
    "overview": _described("overview", "ses"),
    "window": _object(QUERIES["analysis_sessions_summary"]),
    "window_overview": _described("window_overview", "ana"),
    "orders": _object(QUERIES["order_summary"]),
    "revenue_gap": _object(QUERIES["revenue_gap"]),
    "held_weeks": _list(QUERIES["held_weeks"], "week"),
    "audit": _list(QUERIES["audit_scorecard"], "check_order"),
    "funnel_overall": _list(f"SELECT * FROM ({QUERIES['funnel']}) WHERE breakdown = 'overall'", "step_order"),
    "biggest_drop": _object(QUERIES["biggest_drop"]),
    "search": _object(QUERIES["search_vs_intent"]),
    "search_verdict": _object(QUERIES["search_verdict"]),
    "follow_up": _list(QUERIES["experiment_sizing"], "metric_order, relative_lift"),
    "checkout": _object(QUERIES["checkout_mobile_vs_desktop"]),
    "windows": _list(QUERIES["trading_windows"], '"start", "window"'),
    "segments": _list(QUERIES["segments"], "segment_order"),
}
QUERIES["results_document"] = f"""SELECT substr(fullkey, 3) AS path,
  CASE type WHEN 'NULL' THEN 'null' WHEN 'BOOLEAN' THEN 'boolean' WHEN 'VARCHAR' THEN 'string' ELSE 'number' END AS kind,
  CASE WHEN type IN ('BOOLEAN', 'VARCHAR') THEN atom ->> '$' END AS text,
  CASE WHEN type NOT IN ('NULL', 'BOOLEAN', 'VARCHAR', 'OBJECT', 'ARRAY') THEN round(CAST(atom AS DOUBLE), 6) END AS number
 FROM (SELECT to_json(struct_pack({', '.join(f'"{k}" := {v}' for k, v in _DOCUMENT.items())})) AS j) AS whole, json_tree(whole.j)
 WHERE type NOT IN ('OBJECT', 'ARRAY') AND COALESCE(key, '') NOT IN ('check_order', 'segment_order')"""


def sql(query: str) -> str:
    """The query with the shared tables it needs, directly or through others."""
    needed, frontier = set(), query
    while True:
        found = {n for n in CTES if n not in needed and re.search(rf"(?:FROM|JOIN|,)\s+{n}\b", frontier)}
        if not found:
            break
        needed |= found
        frontier = " ".join(CTES[n] for n in found)
    head = ",\n".join(f"{n} AS ({CTES[n]})" for n in CTES if n in needed)
    return f"WITH {head}\n{query}"


def all_sql() -> dict[str, str]:
    return {name: sql(q) for name, q in QUERIES.items()}
