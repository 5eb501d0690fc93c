"""Funnel queries N8, N12-N30 and their oracle SQL."""

from clickspark.operators import funnel as fn
from clickspark.plans.oracle import nz, with_ev, xavg, z0
from clickspark.plans.registry import ev_events, ev_orders, query

V = "CASE WHEN event_type = 'view' THEN 1 ELSE 0 END"
C = "CASE WHEN event_type = 'cart' THEN 1 ELSE 0 END"
P = "CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END"


def pairs_cte(dims: str = "", extra: str = "", name: str = "p") -> str:
    d = (dims + ", ") if dims else ""
    return f"""{name} AS (
  SELECT user_id, product_id, {d}CAST(MAX({V}) AS INTEGER) AS viewed,
    CAST(MAX({C}) AS INTEGER) AS carted, CAST(MAX({P}) AS INTEGER) AS purchased{extra}
  FROM ev GROUP BY user_id, product_id{(', ' + dims) if dims else ''})"""


def sums(dims: str, extra: str = "") -> str:
    return f"""SELECT {dims}, CAST(SUM(viewed) AS BIGINT) AS viewed, CAST(SUM(carted) AS BIGINT) AS carted,
  CAST(SUM(purchased) AS BIGINT) AS purchased{extra} FROM p GROUP BY {dims}"""


RATES3 = (f"{nz('carted', 'viewed')} AS view_to_cart, {nz('purchased', 'carted')} AS cart_to_purchase, "
          f"{nz('purchased', 'viewed')} AS view_to_purchase")


def raw_funnel_sql(fixture: str) -> str:
    return with_ev(f"""SELECT views_unique, carts_unique, purchases_unique,
  {nz('carts_unique', 'views_unique')} AS view_to_cart,
  {nz('purchases_unique', 'carts_unique')} AS cart_to_purchase,
  {nz('purchases_unique', 'views_unique')} AS view_to_purchase
FROM (SELECT CAST(SUM({V}) AS BIGINT) AS views_unique, CAST(SUM({C}) AS BIGINT) AS carts_unique,
        CAST(SUM({P}) AS BIGINT) AS purchases_unique FROM ev) t""", fixture=fixture)


DEDUP_SQL = with_ev(f"""SELECT views_unique, carts_unique, purchases_unique,
  {nz('carts_unique', 'views_unique')} AS view_to_cart,
  {nz('purchases_unique', 'carts_unique')} AS cart_to_purchase,
  {nz('purchases_unique', 'views_unique')} AS view_to_purchase
FROM (SELECT CAST(SUM(viewed) AS BIGINT) AS views_unique, CAST(SUM(carted) AS BIGINT) AS carts_unique,
        CAST(SUM(purchased) AS BIGINT) AS purchases_unique FROM p) t""", pairs_cte())


def dropoff_sql(inner_sql_body: str, *ctes: str) -> str:
    return with_ev(f"""SELECT (1.0 - {z0('carts_unique', 'views_unique')}) * 100 AS dropoff_view_to_cart_pct,
  (1.0 - {z0('purchases_unique', 'carts_unique')}) * 100 AS dropoff_cart_to_purchase_pct
FROM ({inner_sql_body}) f""", *ctes)


@query("clean_events", with_ev("SELECT * FROM ev"))
def _clean(spark, d):
    """N7 over the main fixture: the cleaned event table."""
    return ev_orders(spark, d)


@query("clean_events_eventsfix", with_ev("SELECT * FROM ev", fixture="events"))
def _clean_e(spark, d):
    """N7 over the events fixture (extra event types kept)."""
    return ev_events(spark, d)


@query("funnel_event_counts", with_ev(f"""
SELECT event_type, "count",
  {z0('c', 'v')} * 100 AS view_to_cart_pct, {z0('pu', 'c')} * 100 AS cart_to_purchase_pct
FROM (SELECT event_type, "count",
        SUM(CASE WHEN event_type = 'view' THEN "count" ELSE 0 END) OVER () AS v,
        SUM(CASE WHEN event_type = 'cart' THEN "count" ELSE 0 END) OVER () AS c,
        SUM(CASE WHEN event_type = 'purchase' THEN "count" ELSE 0 END) OVER () AS pu
      FROM (SELECT event_type, COUNT(*) AS "count" FROM ev GROUP BY event_type) g) t"""))
def _fec(spark, d):
    return fn.funnel_event_counts(ev_orders(spark, d))


@query("funnel_event_counts_eventsfix", with_ev(f"""
SELECT event_type, "count",
  {z0('c', 'v')} * 100 AS view_to_cart_pct, {z0('pu', 'c')} * 100 AS cart_to_purchase_pct
FROM (SELECT event_type, "count",
        SUM(CASE WHEN event_type = 'view' THEN "count" ELSE 0 END) OVER () AS v,
        SUM(CASE WHEN event_type = 'cart' THEN "count" ELSE 0 END) OVER () AS c,
        SUM(CASE WHEN event_type = 'purchase' THEN "count" ELSE 0 END) OVER () AS pu
      FROM (SELECT event_type, COUNT(*) AS "count" FROM ev GROUP BY event_type) g) t""", fixture="events"))
def _fec_e(spark, d):
    return fn.funnel_event_counts(ev_events(spark, d))


@query("pair_flags", with_ev("SELECT * FROM p", pairs_cte()))
def _pf(spark, d):
    return fn.pair_flags(ev_orders(spark, d))


@query("funnel_dedup", DEDUP_SQL)
def _fd(spark, d):
    return fn.funnel_dedup(ev_orders(spark, d))


@query("funnel_raw", raw_funnel_sql("orders"))
def _fr(spark, d):
    return fn.funnel_raw(ev_orders(spark, d))


@query("funnel_raw_eventsfix", raw_funnel_sql("events"))
def _fr_e(spark, d):
    return fn.funnel_raw(ev_events(spark, d))


@query("funnel_dropoff_dedup", dropoff_sql(
    "SELECT CAST(SUM(viewed) AS BIGINT) AS views_unique, CAST(SUM(carted) AS BIGINT) AS carts_unique, "
    "CAST(SUM(purchased) AS BIGINT) AS purchases_unique FROM p", pairs_cte()))
def _fdd(spark, d):
    return fn.funnel_dropoff(fn.funnel_dedup(ev_orders(spark, d)))


@query("funnel_dropoff_raw", dropoff_sql(
    f"SELECT SUM({V}) AS views_unique, SUM({C}) AS carts_unique, SUM({P}) AS purchases_unique FROM ev"))
def _fdr(spark, d):
    return fn.funnel_dropoff(fn.funnel_raw(ev_orders(spark, d)))


CATEGORY_SQL = with_ev(f"""SELECT category_code, viewed, carted, purchased,
  {nz('carted', 'viewed')} AS view_to_cart, {nz('purchased', 'carted')} AS cart_to_purchase
FROM ({sums('category_code')}) s""", pairs_cte("category_code"))


@query("category_funnel", CATEGORY_SQL)
def _cf(spark, d):
    return fn.category_funnel(ev_orders(spark, d))


@query("brand_funnel", with_ev(f"""SELECT brand, viewed, carted, purchased, {RATES3},
  1 - {nz('carted', 'viewed')} AS drop_view_cart, 1 - {nz('purchased', 'carted')} AS drop_cart_purchase,
  a.avg_price
FROM ({sums('brand')}) b
LEFT JOIN (SELECT brand AS ab, {xavg('price')} AS avg_price
           FROM ev GROUP BY brand) a ON b.brand = a.ab""", pairs_cte("brand")))
def _bf(spark, d):
    return fn.brand_funnel(ev_orders(spark, d))


@query("hourly_funnel", with_ev(f"SELECT hour, viewed, carted, purchased, {RATES3} FROM ({sums('hour')}) s",
                                pairs_cte("hour")))
def _hf(spark, d):
    return fn.hourly_funnel(ev_orders(spark, d))


@query("brand_analysis", with_ev(f"""SELECT brand, "view", cart, purchase,
  {nz('purchase', '"view"')} AS conversion_rate,
  1 - {nz('cart', '"view"')} AS drop_view_cart, 1 - {nz('purchase', 'cart')} AS drop_cart_purchase,
  avg_price
FROM (SELECT brand, COUNT(*) FILTER (WHERE event_type = 'view') AS "view",
        COUNT(*) FILTER (WHERE event_type = 'cart') AS cart,
        COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchase,
        {xavg('price')} AS avg_price
      FROM ev GROUP BY brand) b"""))
def _ba(spark, d):
    return fn.brand_analysis(ev_orders(spark, d))


@query("pair_cart_abandonment", with_ev(f"""SELECT total_carts, total_purchases,
  {nz('total_carts - total_purchases', 'total_carts')} AS abandonment_rate
FROM (SELECT CAST(SUM(carted) AS BIGINT) AS total_carts, CAST(SUM(purchased) AS BIGINT) AS total_purchases FROM p) t""",
                                        pairs_cte()))
def _pca(spark, d):
    return fn.pair_cart_abandonment(ev_orders(spark, d))


@query("pair_cart_abandonment_strict", with_ev(f"""SELECT total_carts, total_purchases,
  {nz('ab', 'total_carts')} AS abandonment_rate
FROM (SELECT CAST(SUM(carted) AS BIGINT) AS total_carts, CAST(SUM(purchased) AS BIGINT) AS total_purchases,
        CAST(SUM(CASE WHEN carted = 1 AND purchased = 0 THEN 1 ELSE 0 END) AS BIGINT) AS ab FROM p) t""",
                                               pairs_cte()))
def _pcas(spark, d):
    return fn.pair_cart_abandonment(ev_orders(spark, d), strict=True)


RAW_CAT = """SELECT category_code, COUNT(*) FILTER (WHERE event_type = 'view') AS views_raw,
  COUNT(*) FILTER (WHERE event_type = 'cart') AS carts_raw,
  COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases_raw FROM ev GROUP BY category_code"""


@query("category_event_counts", with_ev(RAW_CAT))
def _cec(spark, d):
    return fn.category_event_counts(ev_orders(spark, d))


@query("combined_category_funnel", with_ev(f"""SELECT s.category_code, viewed, carted, purchased,
  {nz('carted', 'viewed')} AS view_to_cart, {nz('purchased', 'carted')} AS cart_to_purchase,
  COALESCE(views_raw, 0) AS views_raw, COALESCE(carts_raw, 0) AS carts_raw,
  COALESCE(purchases_raw, 0) AS purchases_raw,
  {nz('purchased', 'viewed')} AS view_to_purchase,
  {nz('carts_raw', 'views_raw')} AS event_view_to_cart,
  {nz('purchases_raw', 'carts_raw')} AS event_cart_to_purchase,
  COALESCE(views_raw, 0) AS traffic, {nz('purchased', 'viewed')} AS conversion
FROM ({sums('category_code')}) s LEFT JOIN ({RAW_CAT}) r
  ON s.category_code IS NOT DISTINCT FROM r.category_code""", pairs_cte("category_code")))
def _ccf(spark, d):
    return fn.combined_category_funnel(ev_orders(spark, d))


def _period_sql(dims: str, sel: str) -> str:
    return with_ev(f"""SELECT {sel}CASE WHEN is_weekend = 1 THEN 'Weekend' ELSE 'Weekday' END AS period,
  viewed AS views, carted AS carts, purchased AS purchases, {RATES3}
FROM ({sums(dims)}) s""", pairs_cte(dims))


@query("weekend_funnel", _period_sql("is_weekend", ""))
def _wf(spark, d):
    return fn.weekend_funnel(ev_orders(spark, d))


@query("hourly_weekend_funnel", _period_sql("hour, is_weekend", "hour, "))
def _hwf(spark, d):
    return fn.hourly_weekend_funnel(ev_orders(spark, d))


@query("monthly_funnel", with_ev(f"""SELECT month, views, carts, purchases,
  {nz('carts', 'views')} AS view_to_cart, {nz('purchases', 'carts')} AS cart_to_purchase,
  {nz('purchases', 'views')} AS view_to_purchase
FROM (SELECT DATE_TRUNC('month', event_time) AS month,
        COUNT(*) FILTER (WHERE event_type = 'view') AS views,
        COUNT(*) FILTER (WHERE event_type = 'cart') AS carts,
        COUNT(*) FILTER (WHERE event_type = 'purchase') AS purchases
      FROM ev GROUP BY 1) t"""))
def _mf(spark, d):
    return fn.monthly_funnel(ev_orders(spark, d))


@query("hour_period_matrix", with_ev(f"""SELECT hour,
  MAX(CASE WHEN is_weekend = 0 THEN {nz('purchased', 'viewed')} END) AS "Weekday",
  MAX(CASE WHEN is_weekend = 1 THEN {nz('purchased', 'viewed')} END) AS "Weekend"
FROM ({sums('hour, is_weekend')}) s GROUP BY hour""", pairs_cte("hour, is_weekend")))
def _hpm(spark, d):
    return fn.hour_period_matrix(fn.hourly_weekend_funnel(ev_orders(spark, d)))


def _top_sql(order: str) -> str:
    return with_ev(f"""SELECT category_code, viewed, carted, purchased,
  {nz('carted', 'viewed')} AS view_to_cart, {nz('purchased', 'carted')} AS cart_to_purchase
FROM ({sums('category_code')}) s ORDER BY {order}, category_code LIMIT 10""", pairs_cte("category_code"))


@query("top_categories_by_purchased", _top_sql("purchased DESC"))
def _tcp(spark, d):
    return fn.top_categories(fn.category_funnel(ev_orders(spark, d)), "purchased", 10)


@query("top_categories_by_viewed", _top_sql("viewed DESC"))
def _tcv(spark, d):
    return fn.top_categories(fn.category_funnel(ev_orders(spark, d)), "viewed", 10)


@query("bottom_categories_by_purchased", _top_sql("purchased ASC"))
def _bcp(spark, d):
    return fn.top_categories(fn.category_funnel(ev_orders(spark, d)), "purchased", 10, ascending=True)


@query("category_traffic_histogram", with_ev(f"""
SELECT b.bin, a + (bb - a) * (b.bin - 1) / 20 AS bin_start, a + (bb - a) * b.bin / 20 AS bin_end,
  COALESCE(h.cnt, 0) AS "count"
FROM (SELECT CAST(range + 1 AS INTEGER) AS bin FROM range(20)) b
CROSS JOIN (SELECT CASE WHEN hi = lo THEN lo - 0.5 ELSE CAST(lo AS DOUBLE) END AS a,
                   CASE WHEN hi = lo THEN hi + 0.5 ELSE CAST(hi AS DOUBLE) END AS bb FROM s) e
LEFT JOIN (SELECT CAST(CASE WHEN s.hi = s.lo THEN 10 ELSE LEAST(19, floor((r.views_raw - s.lo) * 20 / (s.hi - s.lo))) END + 1 AS INTEGER) AS bin,
                  COUNT(*) AS cnt
           FROM r, s GROUP BY 1) h ON h.bin = b.bin""",
    f"r AS ({RAW_CAT})", "s AS (SELECT MIN(views_raw) AS lo, MAX(views_raw) AS hi FROM r)"))
def _cth(spark, d):
    return fn.category_traffic_histogram(fn.category_event_counts(ev_orders(spark, d)))


def _user_funnel_sql(fixture: str) -> str:
    return with_ev(f"""SELECT total_users, viewed, carted, purchased, cart_abandoners,
  {nz('viewed', 'total_users')} * 100 AS view_rate_pct,
  {nz('carted', 'viewed')} * 100 AS cart_rate_pct,
  {nz('purchased', 'carted')} * 100 AS purchase_rate_pct,
  {nz('purchased', 'total_users')} * 100 AS overall_cvr_pct,
  {nz('cart_abandoners', 'carted')} * 100 AS cart_abandonment_pct
FROM (SELECT COUNT(*) AS total_users, CAST(SUM(dv) AS BIGINT) AS viewed, CAST(SUM(dc) AS BIGINT) AS carted,
        CAST(SUM(dp) AS BIGINT) AS purchased,
        CAST(SUM(CASE WHEN dc = 1 AND dp = 0 THEN 1 ELSE 0 END) AS BIGINT) AS cart_abandoners
      FROM (SELECT user_id, MAX({V}) AS dv, MAX({C}) AS dc, MAX({P}) AS dp FROM ev GROUP BY user_id) u) t""",
                   fixture=fixture)


@query("user_funnel", _user_funnel_sql("orders"))
def _uf(spark, d):
    return fn.user_funnel(ev_orders(spark, d))


@query("user_funnel_eventsfix", _user_funnel_sql("events"))
def _uf_e(spark, d):
    return fn.user_funnel(ev_events(spark, d))


def _tier_sql() -> str:
    e = fn.PRICE_TIER_EDGES
    last = len(e) - 1
    whens = " ".join(f"WHEN price >= {e[i]} AND price < {e[i + 1]} THEN '{e[i]:g}-{e[i + 1]:g}'"
                     for i in range(last))
    return f"CASE {whens} WHEN price >= {e[last]} THEN '{e[last]:g}+' END"


@query("price_tier_funnel", with_ev(
    f"SELECT price_tier, viewed, carted, purchased, {RATES3} FROM ({sums('price_tier')}) s",
    f"evt AS (SELECT *, {_tier_sql()} AS price_tier FROM ev)",
    pairs_cte("price_tier").replace("FROM ev", "FROM evt")))
def _ptf(spark, d):
    return fn.price_tier_funnel(ev_orders(spark, d))
