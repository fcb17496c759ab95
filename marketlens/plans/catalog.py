"""All queries of the engine by name, each with its DuckDB oracle where SQL can state it."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.functions import theme_rules as R
from marketlens.operators import documents as D
from marketlens.operators import answers, cube, eda, enrich, index, ivf, kpi, manifests, presentation, quality, questions, retrieval, sampling, scaling, themes
from marketlens.operators import evaluation as E
from marketlens.session import shared_folder, table, written
from marketlens.sources import domain as V
from marketlens.sources.bucketed import BucketTable

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
#: Least number of reviews in a group that is compared.
LEAST = 5
PERIOD = kpi.Filters(start_month="1995-06", end_month="1995-08")


def query(name: str, sql: str | None = None, prelude: bool = True) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = (V.PRELUDE + _MORE if prelude else "") + sql
        return f

    return add


def enriched_orders(s: SparkSession, d: str) -> DataFrame:
    return enrich.orders_enriched(V.orders(s, d), V.items(s, d), V.payments(s, d), V.customers(s, d), V.places(s, d))


def facts(s: SparkSession, d: str, between: tuple[int | None, int | None] | None = None) -> DataFrame:
    """What is asked of orders most often (of those with ids ``between`` two, where given), by one scan of each table."""
    return enrich.order_facts(V.order_lines(s, d, between=between), V.customers(s, d))


def enriched_reviews(s: SparkSession, d: str) -> DataFrame:
    links = V.links(s, d)
    return enrich.reviews_enriched(V.reviews(s, d), links, facts(s, d, enrich.order_span(links)))


def annotated_reviews(s: SparkSession, d: str) -> DataFrame:
    """Enriched reviews with their themes."""
    return themes.annotated(enriched_reviews(s, d), rules=R.RULES_SYNTHETIC)


def synthetic_themes(s: SparkSession, d: str) -> DataFrame:
    """Themes come from texts alone: no order is read for them."""
    return themes.classify(enrich.canonical_texts(V.reviews(s, d)), rules=R.RULES_SYNTHETIC)


def text_list(c: str) -> F.Column:
    return F.array_join(F.col(c).cast("array<string>"), ",")


def _sql_words(rules: dict[str, str]) -> str:
    return ", ".join(f"CASE WHEN regexp_matches(plain, '{R.whole_words(p)}') THEN '{t}' END" for t, p in rules.items())


def _sql_theme_array(rules: dict[str, str], positive: bool) -> str:
    pos = f"WHEN regexp_matches(plain, '{R.whole_words(R.POSITIVE)}') THEN ['other']" if positive else ""
    words = "len(list_filter(string_split(plain, ' '), lambda w: length(w) > 1))"
    found = f"list_filter([{_sql_words(rules)}], lambda x: x IS NOT NULL)"
    return f"CASE WHEN len({found}) > 0 THEN {found} {pos} WHEN {words} < 4 THEN ['uncertain'] ELSE ['other'] END"


def _dec_mean(total: str, n: str, kind: str = "DECIMAL(18,2)") -> str:
    return f"CAST(CAST(sum({total}) AS {kind}) AS DOUBLE) / nullif(count({n}), 0)"


_SET = "list_aggregate(list_sort(list_distinct(list({c}))), 'string_agg', ',')"
_PLAIN = "trim(lower(regexp_replace(coalesce({c}, ''), '[^\\p{{L}}]+', ' ', 'g')))"
_DELAY = "CAST(CASE WHEN is_late THEN delivery_delay_days END AS DECIMAL(18,3))"
_MORE = f"""
, e_items AS (
  SELECT *, CAST(item_subtotal + freight_total AS DECIMAL(18,2)) AS order_value,
    unknown_category_item_count = 0 AND distinct_known_category_count = 1 AS is_strict_mono_category,
    CASE WHEN unknown_category_item_count = 0 AND distinct_known_category_count = 1 THEN any_category END AS order_category
  FROM (SELECT order_id, count(*) AS item_count, count(DISTINCT product_id) AS distinct_product_count, count(DISTINCT seller_id) AS distinct_seller_count,
      count(DISTINCT product_category) AS distinct_known_category_count, count(*) FILTER (product_category IS NULL) AS unknown_category_item_count,
      CAST(sum(price) AS DECIMAL(18,2)) AS item_subtotal, CAST(sum(freight) AS DECIMAL(18,2)) AS freight_total,
      {_SET.format(c='product_id')} AS product_ids, {_SET.format(c='seller_id')} AS seller_ids, {_SET.format(c='product_category')} AS product_categories,
      {_SET.format(c='seller_state')} AS seller_states, min(product_category) AS any_category FROM d_items GROUP BY order_id)),
e_orders0 AS (
  SELECT *, round((epoch(delivered_ts) - epoch(purchase_ts)) / 86400.0::DOUBLE, 3) AS delivery_time_days,
    round((epoch(delivered_ts) - epoch(estimated_ts)) / 86400.0::DOUBLE, 3) AS delivery_delay_days,
    CASE WHEN delivered_ts IS NOT NULL AND estimated_ts IS NOT NULL THEN delivered_ts > estimated_ts END AS is_late,
    CAST(year(purchase_ts) AS INTEGER) AS purchase_year, CAST(month(purchase_ts) AS INTEGER) AS purchase_month, CAST(purchase_ts AS DATE) AS purchase_date
  FROM d_orders),
e_orders AS (
  SELECT o.*, customer_state, customer_city, zip, item_count, order_value, is_strict_mono_category, order_category, product_ids, item_subtotal, freight_total
  FROM e_orders0 o LEFT JOIN e_items i USING (order_id) LEFT JOIN d_customers c USING (customer_id)),
e_canonical AS (
  SELECT review_id, review_score, title, message, lang,
    CASE WHEN nullif(trim(title), '') IS NOT NULL AND nullif(trim(message), '') IS NOT NULL THEN trim(title) || chr(10) || chr(10) || trim(message)
      ELSE coalesce(nullif(trim(title), ''), nullif(trim(message), '')) END AS review_text,
    nullif(trim(title), '') IS NOT NULL AS has_title, nullif(trim(message), '') IS NOT NULL AS has_message
  FROM d_reviews),
e_meta AS (
  SELECT review_id, count(DISTINCT order_id) AS linked_order_count, {_SET.format(c='order_id')} AS linked_order_ids,
    CASE WHEN count(*) FILTER (is_strict_mono_category) = count(*) AND count(order_category) = count(*) AND count(DISTINCT order_category) = 1 THEN min(order_category) END AS product_category,
    CASE WHEN count(customer_state) = count(*) AND count(DISTINCT customer_state) = 1 THEN min(customer_state) END AS customer_state,
    CASE WHEN count(order_status) = count(*) AND count(DISTINCT order_status) = 1 THEN min(order_status) END AS order_status,
    CASE WHEN count(purchase_year) = count(*) AND count(DISTINCT purchase_year) = 1 THEN min(purchase_year) END AS purchase_year,
    CASE WHEN count(purchase_month) = count(*) AND count(DISTINCT purchase_month) = 1 THEN min(purchase_month) END AS purchase_month
  FROM d_links LEFT JOIN e_orders USING (order_id) GROUP BY review_id),
e_reviews AS (
  SELECT c.*, review_text IS NOT NULL AS text_is_eligible, {_PLAIN.format(c='review_text')} AS plain, linked_order_count, linked_order_ids, product_category,
    customer_state, order_status, purchase_year, purchase_month, CASE WHEN review_score <= 2 THEN 1 ELSE 0 END AS negative
  FROM e_canonical c LEFT JOIN e_meta USING (review_id)),
e_rag AS (SELECT *, text_is_eligible AND len(list_filter(string_split(plain, ' '), lambda w: length(w) >= 2)) > 0 AS rag FROM e_reviews),
e_themes AS (
  SELECT DISTINCT review_id, review_score, unnest({_sql_theme_array(R.RULES_SYNTHETIC, True)}) AS theme FROM e_rag WHERE rag)
"""
_MONTHLY = f"""
, m AS (SELECT make_date(purchase_year, purchase_month, 1) AS month, sum(review_score) AS rating_sum, sum(negative) AS negative_sum, count(*) AS review_count,
    CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS average_rating, CAST(sum(negative) AS DOUBLE) / count(*) AS negative_rate,
    CAST(count(*) FILTER (text_is_eligible) AS DOUBLE) / count(*) AS text_coverage, count(*) >= {LEAST} AS is_eligible
  FROM e_reviews WHERE purchase_year IS NOT NULL AND purchase_month IS NOT NULL GROUP BY 1),
g AS (SELECT *, count(*) OVER w AS baseline_months, CASE WHEN count(*) OVER w = 3 THEN CAST(sum(rating_sum) OVER w AS DOUBLE) / nullif(sum(review_count) OVER w, 0) END AS baseline_rating
  FROM m WHERE is_eligible WINDOW w AS (ORDER BY month ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
mm AS (SELECT *, average_rating - baseline_rating AS rating_variation FROM g UNION ALL SELECT *, NULL, NULL, NULL FROM m WHERE NOT is_eligible)
"""
_MONTHLY_COLUMNS = "month, CAST(rating_sum AS BIGINT) AS rating_sum, CAST(negative_sum AS BIGINT) AS negative_sum, review_count, average_rating, negative_rate, text_coverage, is_eligible, baseline_months, baseline_rating, rating_variation"


# --- KPIs ---------------------------------------------------------------------------------------------------------


_ORDER_KPI = f"""count(DISTINCT order_id) AS order_count, count(order_value) AS order_value_count, {_dec_mean('order_value', 'order_value')} AS average_order_value,
  count(is_late) AS delivery_eligible_count, count(*) FILTER (is_late) AS late_count, CAST(count(*) FILTER (is_late) AS DOUBLE) / nullif(count(is_late), 0) AS late_rate,
  count(*) FILTER (is_late) AS delivery_delay_eligible_count, {_dec_mean(_DELAY, _DELAY, 'DECIMAL(18,3)')} AS average_delay_days"""


@query("kpi_orders_overall", f"SELECT {_ORDER_KPI} FROM e_orders")
def kpi_orders_overall(s, d):
    return kpi.order_summary(facts(s, d))


@query("kpi_reviews_overall", """SELECT count(review_score) AS review_count, CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS average_rating,
  count(*) FILTER (review_score <= 2) AS negative_count, count(*) FILTER (review_score = 1) AS score_1_count, count(*) FILTER (review_score = 2) AS score_2_count FROM e_reviews""")
def kpi_reviews_overall(s, d):
    return kpi.review_summary(enriched_reviews(s, d))


def _report_sql(base: str, by: str = "") -> str:
    """The report from the sums r and o of each row of ``base`` (``by`` and window_)."""
    keys = f"{by}, window_" if by else "window_"
    g, joined = (f"{by}, " if by else ""), f"USING ({keys})"
    lines = [("average_rating", "rating", "NULL::DOUBLE", "n"), ("negative_rate", "neg::DOUBLE / nullif(n, 0)", "neg", "n"), ("score_1_share", "s1::DOUBLE / nullif(n, 0)", "s1", "n"), ("score_2_share", "s2::DOUBLE / nullif(n, 0)", "s2", "n"), ("late_rate", "late_rate", "late_count", "eligible"), ("average_delay_days", "average_delay_days", "NULL::DOUBLE", "late_count"), ("order_volume", "order_count::DOUBLE", "order_count", "order_count"), ("average_order_value", "average_order_value", "NULL::DOUBLE", "order_value_count")]
    long = " UNION ALL ".join(f"SELECT {keys}, '{m}' AS metric, {v} AS v, ({x})::DOUBLE AS a, ({y})::DOUBLE AS b FROM one" for m, v, x, y in lines)
    return f"""
, one AS (SELECT {keys}, coalesce(n, 0) AS n, rating, coalesce(neg, 0) AS neg, coalesce(s1, 0) AS s1, coalesce(s2, 0) AS s2, coalesce(order_count, 0) AS order_count,
  coalesce(order_value_count, 0) AS order_value_count, average_order_value, coalesce(delivery_eligible_count, 0) AS eligible, coalesce(late_count, 0) AS late_count, late_rate, average_delay_days
  FROM {base} LEFT JOIN r {joined} LEFT JOIN o {joined}), long AS ({long})
, k AS (SELECT {g}metric, max(v) FILTER (window_ = 'current') AS "value", max(v) FILTER (window_ = 'baseline') AS baseline,
  CASE WHEN metric <> 'order_volume' THEN max(v) FILTER (window_ = 'current') - max(v) FILTER (window_ = 'baseline') END AS change, max(a) FILTER (window_ = 'current') AS numerator, max(b) FILTER (window_ = 'current') AS denominator,
  max(a) FILTER (window_ = 'baseline') AS baseline_numerator, max(b) FILTER (window_ = 'baseline') AS baseline_denominator FROM long GROUP BY {g}metric)
SELECT * FROM k UNION ALL SELECT {g}'rating_variation', change, NULL, NULL, NULL, NULL, NULL, NULL FROM k WHERE metric = 'average_rating'"""


_REVIEW_KPI = "count(review_score) AS n, CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS rating, count(*) FILTER (review_score <= 2) AS neg, count(*) FILTER (review_score = 1) AS s1, count(*) FILTER (review_score = 2) AS s2"
_PERIOD_SQL = f"""
, wr AS (SELECT CASE WHEN purchase_year * 12 + purchase_month BETWEEN 1995*12+6 AND 1995*12+8 THEN 'current' ELSE 'baseline' END AS window_, * FROM e_reviews
  WHERE purchase_year * 12 + purchase_month BETWEEN 1995*12+3 AND 1995*12+8),
wo AS (SELECT CASE WHEN purchase_date >= DATE '1995-06-01' THEN 'current' ELSE 'baseline' END AS window_, * FROM e_orders WHERE purchase_date >= DATE '1995-03-01' AND purchase_date < DATE '1995-09-01'),
r AS (SELECT window_, {_REVIEW_KPI} FROM wr GROUP BY 1), o AS (SELECT window_, {_ORDER_KPI} FROM wo GROUP BY 1)
""" + _report_sql("(VALUES ('current'), ('baseline')) w(window_)")


def order_facts(s: SparkSession, d: str, filters: kpi.Filters | None = None) -> DataFrame:
    """What KPIs need of each order, of a period and its baseline where given: written once, as orders and reviews both
    read it."""
    where = None
    if filters:
        first, last = (kpi.baseline(filters) or filters).start_month, filters.validated().end_month
        date = F.col("o_orderdate")
        where = (date >= F.lit(f"{first}-01").cast("timestamp_ntz")) & (date < F.lit(f"{kpi.shift_month(last, 1)}-01").cast("timestamp_ntz"))
    return written(enrich.order_facts(V.order_lines(s, d, where), V.customers(s, d)), "order-facts")


@query("kpi_period_vs_baseline", _PERIOD_SQL)
def kpi_period_vs_baseline(s, d):
    facts = order_facts(s, d, PERIOD)
    return kpi.analyze(facts, enrich.review_facts(V.scored_links(s, d), facts), PERIOD)


_shown = lambda x, d, sign="": f"printf('%{sign}.{d}f', floor(({x}) * {10**d} + 0.5) / {float(10**d)})"
_text = lambda c, sign="": f"CASE WHEN {c} IS NULL THEN 'n.d.' WHEN kind = 'percentage' THEN {_shown(c + ' * 100', 2, sign)} || '%' WHEN kind = 'integer' THEN replace(format('{{:,}}', CAST(floor({c}) AS BIGINT)), ',', '.') ELSE {_shown(c, 3, sign)} END"
_RENAMED = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in presentation.REPORTED.items())
_CARDS = ", ".join(f"({i}, '{k}', '{label}', '{kind}')" for i, (k, (label, kind)) in enumerate(presentation.CARDS.items()))


@query("kpi_shown", f"""SELECT place, metric, label, {_text("value")} AS value, {_text("baseline")} AS baseline, {_text("change", "+")} AS change
FROM (SELECT place, metric, label, kind, CAST(value AS DOUBLE) AS value, CAST(baseline AS DOUBLE) AS baseline, CASE WHEN metric <> 'order_volume' THEN CAST(change AS DOUBLE) END AS change FROM (SELECT * REPLACE (CASE metric {_RENAMED} ELSE metric END AS metric) FROM ({ORACLES["kpi_period_vs_baseline"]})) JOIN (VALUES {_CARDS}) AS c(place, metric, label, kind) USING (metric))""", False)
def kpi_shown(s, d):
    """The cards of the period's report, as texts."""
    return presentation.shown_kpis(kpi_period_vs_baseline(s, d))


def kpi_filters(s: SparkSession, d: str) -> DataFrame:
    """Four filters for each nation: the state, the state and three months, a category and a month, both and some years."""
    n = table(s, d, "nation").join(table(s, d, "part").select((F.col("p_partkey") - 1).cast("int").alias("n_nationkey"), F.lower("p_type").alias("category")), "n_nationkey", "left")
    month = lambda first, by: F.date_format(F.add_months(F.lit(first).cast("date"), F.col("n_nationkey") + by), "yyyy-MM")
    none, state = F.lit(None).cast("string"), F.lower("n_name")
    kinds = [(none, state, none, none), (none, state, month("1995-01-01", 0), month("1995-01-01", 2)), (F.col("category"), none, month("1996-01-01", 0), none), (F.col("category"), state, F.lit("1995-06"), F.lit("1999-12"))]
    names = ("category", "state", "start_month", "end_month")
    rows = F.array(*[F.struct((F.col("n_nationkey") * 4 + j).alias("filter_id"), *[v.alias(c) for c, v in zip(names, kind, strict=True)]) for j, kind in enumerate(kinds)])
    return n.select(F.explode(rows).alias("f")).select("f.*")


def kpi_cube(s: SparkSession, d: str) -> cube.Cube:
    facts = order_facts(s, d)
    return cube.build(facts, enrich.review_facts(V.scored_links(s, d), facts))


_CUBE_SQL = f"""
, n AS (SELECT n_nationkey AS nk, n_name AS state, lower(p_type) AS category FROM nation LEFT JOIN part ON p_partkey = n_nationkey + 1),
f AS (SELECT nk * 4 AS filter_id, NULL AS category, state, NULL::INTEGER AS lo, NULL::INTEGER AS hi FROM n UNION ALL SELECT nk * 4 + 1, NULL, state, 1995 * 12 + 1 + nk, 1995 * 12 + 3 + nk FROM n
  UNION ALL SELECT nk * 4 + 2, category, NULL, 1996 * 12 + 1 + nk, 1996 * 12 + 1 + nk FROM n UNION ALL SELECT nk * 4 + 3, category, state, 1995 * 12 + 6, 1999 * 12 + 12 FROM n),
w AS (SELECT *, 'current' AS window_ FROM f UNION ALL SELECT filter_id, category, state, lo - 3, lo - 1, 'baseline' FROM f WHERE lo IS NOT NULL),
m AS (SELECT *, purchase_year * 12 + purchase_month AS mon FROM e_reviews), mo AS (SELECT *, year(purchase_date) * 12 + month(purchase_date) AS mon FROM e_orders),
r AS (SELECT filter_id, window_, {_REVIEW_KPI} FROM w JOIN m ON (w.category IS NULL OR product_category = w.category) AND (w.state IS NULL OR upper(customer_state) = w.state) AND (lo IS NULL OR mon BETWEEN lo AND hi) GROUP BY 1, 2),
wo AS (SELECT * FROM w JOIN mo ON (w.category IS NULL OR order_category = w.category) AND (w.state IS NULL OR upper(customer_state) = w.state) AND (lo IS NULL OR mon BETWEEN lo AND hi)),
o AS (SELECT filter_id, window_, {_ORDER_KPI} FROM wo GROUP BY 1, 2)
"""


@query("kpi_cube_report", _CUBE_SQL + _report_sql("(SELECT filter_id, window_ FROM f, (VALUES ('current'), ('baseline')) v(window_))", "filter_id"))
def kpi_cube_report(s, d):
    """The report of 100 filters from one cube."""
    return cube.answers(kpi_cube(s, d), kpi_filters(s, d))


@query("kpi_cube_statuses", _CUBE_SQL + """, t AS (SELECT filter_id, coalesce(order_status, 'unknown') AS status, count(*) FILTER (window_ = 'current') AS c, count(*) FILTER (window_ = 'baseline') AS b FROM wo GROUP BY 1, 2)
SELECT filter_id, status, nullif(c, 0) AS current_count, CAST(nullif(c, 0) AS DOUBLE) / nullif(sum(c) OVER (PARTITION BY filter_id), 0) AS current_share, nullif(b, 0) AS baseline_count, CAST(nullif(b, 0) AS DOUBLE) / nullif(sum(b) OVER (PARTITION BY filter_id), 0) AS baseline_share FROM t""")
def kpi_cube_statuses(s, d):
    return cube.statuses(kpi_cube(s, d), kpi_filters(s, d))


@query("kpi_low_rating_share", "SELECT product_category, count(review_score) AS review_count, CAST(count(*) FILTER (review_score <= 2) AS DOUBLE) / nullif(count(review_score), 0) AS low_share FROM e_reviews GROUP BY 1")
def kpi_low_rating_share(s, d):
    r = kpi.review_summary(enriched_reviews(s, d), "product_category")
    return r.select("product_category", "review_count", S.rate(F.col("negative_count"), F.col("review_count")).alias("low_share"))


@query("kpi_status_distribution", """, c AS (SELECT coalesce(order_status, 'unknown') AS status, count(*) AS n FROM e_orders0 WHERE purchase_date >= DATE '1995-06-01' AND purchase_date < DATE '1995-09-01' GROUP BY 1),
b AS (SELECT coalesce(order_status, 'unknown') AS status, count(*) AS n FROM e_orders0 WHERE purchase_date >= DATE '1995-03-01' AND purchase_date < DATE '1995-06-01' GROUP BY 1)
SELECT status, c.n AS current_count, CAST(c.n AS DOUBLE) / (SELECT sum(n) FROM c) AS current_share, CAST(b.n AS DOUBLE) / (SELECT sum(n) FROM b) AS baseline_share FROM c FULL JOIN b USING (status)""")
def kpi_status_distribution(s, d):
    return kpi.status_comparison(enrich.with_delivery(V.orders(s, d)), PERIOD)


# --- quality ------------------------------------------------------------------------------------------------------


@query("null_profile", """SELECT unnest(['review_score', 'title', 'message', 'lang']) AS column_name,
  unnest([count(*) FILTER (review_score IS NULL), count(*) FILTER (title IS NULL), count(*) FILTER (message IS NULL), count(*) FILTER (lang IS NULL)]) AS null_count, count(*) AS total,
  unnest([count(*) FILTER (review_score IS NULL), count(*) FILTER (title IS NULL), count(*) FILTER (message IS NULL), count(*) FILTER (lang IS NULL)])::DOUBLE / count(*) AS null_rate FROM d_reviews""")
def null_profile(s, d):
    return quality.null_profile(V.reviews(s, d), ["review_score", "title", "message", "lang"])


@query("duplicate_keys", "SELECT (SELECT count(*) FROM lineitem WHERE l_orderkey IS NULL OR l_linenumber IS NULL) AS null_keys, count(*) AS duplicate_keys FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)", False)
def duplicate_keys(s, d):
    return quality.key_violations(table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("fk_orphans", "SELECT DISTINCT o_orderkey AS orphan_key FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)", False)
def fk_orphans(s, d):
    return quality.orphans(table(s, d, "orders"), "o_orderkey", table(s, d, "lineitem"), "l_orderkey")


@query("payload_consistency", "SELECT c_nationkey, count(DISTINCT to_json({'c_mktsegment': c_mktsegment})::VARCHAR) AS payloads FROM customer GROUP BY 1", False)
def payload_consistency(s, d):
    return quality.payloads(table(s, d, "customer"), "c_nationkey", ["c_mktsegment"])


@query("fanout_report", "SELECT (SELECT count(*) FROM orders) AS rows_before, count(*) AS rows_after FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey", False)
def fanout_report(s, d):
    return quality.fanout_report(table(s, d, "orders").select(F.col("o_orderkey").alias("k")), table(s, d, "lineitem").select(F.col("l_orderkey").alias("k")), "k")


@query("guarded_join", "SELECT order_id, customer_state FROM d_orders LEFT JOIN d_customers USING (customer_id)")
def guarded_join(s, d):
    return quality.join_without_fanout(V.orders(s, d), V.customers(s, d), "customer_id", "orders to customers").select("order_id", "customer_state")


@query("guarded_write", """, n AS (SELECT o.order_id, count(c.customer_id) AS found FROM d_orders o LEFT JOIN d_customers c USING (customer_id) GROUP BY 1)
SELECT order_id, found > 0 AS has_customer, (SELECT count(*) FROM d_orders) AS rows_before, (SELECT count(*) FROM d_orders LEFT JOIN d_customers USING (customer_id)) AS rows_after, (SELECT count(*) FROM d_orders WHERE customer_id IS NULL) AS null_keys FROM n""")
def guarded_write(s, d):
    """Orders with their customers, written under a guard, beside what the guard saw."""
    path = f"{shared_folder(s)}/guarded-{uuid.uuid4().hex}"
    orders = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    seen = quality.write_guarded(orders, V.customers(s, d), "customer_id", path, "orders to customers")
    return s.read.parquet(path).select("order_id", F.col("customer_state").isNotNull().alias("has_customer"), *[F.lit(seen[c]).cast("long").alias(c) for c in ("rows_before", "rows_after", "null_keys")])


@query("trim_normalize", """SELECT doc_id, nullif(trim(x), '') AS trimmed, lower(nullif(trim(x), '')) AS category, upper(nullif(trim(x), '')) AS state
  FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '   ' WHEN doc_id % 7 = 0 THEN NULL ELSE '  ' || source || ' ' END AS x FROM documents)""", False)
def trim_normalize(s, d):
    x = F.when(F.col("doc_id") % 5 == 0, "   ").when(F.col("doc_id") % 7 != 0, F.concat(F.lit("  "), "source", F.lit(" ")))
    return table(s, d, "documents").select("doc_id", S.trimmed(x).alias("trimmed"), S.category(x).alias("category"), S.state(x).alias("state"))


@query("safe_casts", """SELECT doc_id, TRY_CAST(x AS INTEGER) AS as_int, TRY_CAST(x AS DOUBLE) AS as_double, CAST(TRY_CAST(x AS DECIMAL(18,2)) AS DOUBLE) AS as_money, CAST(TRY_CAST(t AS TIMESTAMP) AS VARCHAR) AS as_time
  FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'bad' ELSE CAST(doc_id AS VARCHAR) END AS x, CASE WHEN doc_id % 4 = 0 THEN 'never' ELSE '2018-03-01 10:11:12' END AS t FROM documents)""", False)
def safe_casts(s, d):
    x = F.when(F.col("doc_id") % 3 == 0, "bad").otherwise(F.col("doc_id").cast("string"))
    t = F.when(F.col("doc_id") % 4 == 0, "never").otherwise("2018-03-01 10:11:12")
    return table(s, d, "documents").select(
        "doc_id", S.typed(x, "int").alias("as_int"), S.typed(x, "double").alias("as_double"), S.typed(x, "decimal(18,2)").cast("double").alias("as_money"), S.timestamp(t).cast("string").alias("as_time")
    )


@query("category_translation", """, names AS (SELECT DISTINCT product_category AS c, 'en_' || product_category AS english FROM d_items WHERE length(product_category) % 2 = 0)
SELECT product_category, coalesce(english, product_category) AS category, CASE WHEN english IS NOT NULL THEN 'english' WHEN product_category IS NOT NULL THEN 'portuguese_fallback' END AS category_source, count(*) AS n
FROM d_items LEFT JOIN names ON c = product_category GROUP BY 1, 2, 3""")
def category_translation(s, d):
    items = V.items(s, d)
    c = F.col("product_category")
    names = items.where(F.length(c) % 2 == 0).select(c.alias("c")).distinct().withColumn("english", F.concat(F.lit("en_"), "c"))
    source = F.when(F.col("english").isNotNull(), "english").when(c.isNotNull(), "portuguese_fallback")
    rows = items.join(names, items.product_category == names.c, "left").drop("c")
    return rows.groupBy("product_category", F.coalesce("english", "product_category").alias("category"), source.alias("category_source")).agg(F.count(F.lit(1)).alias("n"))


@query("csv_json_projection", """SELECT order_id, '[' || product_ids || ']' AS product_ids FROM e_items""")
def csv_json_projection(s, d):
    return (lambda x: x.select(*S.csv_safe(x)))(enrich.items_by_order(V.items(s, d)).select("order_id", "product_ids"))


# --- enrichment ---------------------------------------------------------------------------------------------------


@query("items_by_order", """SELECT order_id, item_count, distinct_product_count, distinct_seller_count, distinct_known_category_count, unknown_category_item_count, CAST(item_subtotal AS DOUBLE) AS item_subtotal,
  CAST(freight_total AS DOUBLE) AS freight_total, product_ids, seller_ids, coalesce(product_categories, '') AS product_categories, seller_states, CAST(order_value AS DOUBLE) AS order_value, is_strict_mono_category, order_category FROM e_items""")
def items_by_order(s, d):
    x = enrich.items_by_order(V.items(s, d))
    money = {c: F.col(c).cast("double") for c in ("item_subtotal", "freight_total", "order_value")}
    return x.withColumns(money | {c: text_list(c) for c in ("product_ids", "seller_ids", "product_categories", "seller_states")})


@query("payments_by_order", f"""SELECT order_id, count(*) AS payment_sequence_count, count(DISTINCT payment_type) AS distinct_payment_type_count, {_SET.format(c='payment_type')} AS payment_types,
  max(installments) AS max_payment_installments, CAST(CAST(sum(payment_value) AS DECIMAL(18,2)) AS DOUBLE) AS payment_total FROM d_payments GROUP BY 1""")
def payments_by_order(s, d):
    x = enrich.payments_by_order(V.payments(s, d))
    return x.withColumns({"payment_types": text_list("payment_types"), "payment_total": F.col("payment_total").cast("double")})


@query("geo_by_zip", """, n AS (SELECT zip, city, state, count(*) AS k, row_number() OVER (PARTITION BY zip ORDER BY count(*) DESC, city NULLS LAST, state NULLS LAST) AS rn FROM d_places GROUP BY 1, 2, 3)
SELECT zip, CAST(CAST(sum(balance) AS DECIMAL(18,2)) AS DOUBLE) / count(balance) / 100 AS geolocation_lat, -CAST(CAST(sum(balance) AS DECIMAL(18,2)) AS DOUBLE) / count(balance) / 100 AS geolocation_lng,
  count(*) AS geolocation_observation_count, any_value(n.city) AS geolocation_city, any_value(n.state) AS geolocation_state, any_value(k) AS place_observation_count
FROM d_places p JOIN (SELECT zip AS z, city, state, k FROM n WHERE rn = 1) n ON z = zip GROUP BY zip""")
def geo_by_zip(s, d):
    return enrich.place_by_zip(V.places(s, d))


@query("orders_enriched", f"""SELECT o.order_id, order_status, delivery_time_days, delivery_delay_days, is_late, purchase_year, purchase_month, CAST(purchase_date AS VARCHAR) AS purchase_date, item_count,
  CAST(order_value AS DOUBLE) AS order_value, order_category, customer_state, p.payment_total, o.zip FROM e_orders o
  LEFT JOIN (SELECT order_id, CAST(CAST(sum(payment_value) AS DECIMAL(18,2)) AS DOUBLE) AS payment_total FROM d_payments GROUP BY 1) p USING (order_id)""")
def orders_enriched(s, d):
    x = enriched_orders(s, d)
    return x.select(
        "order_id", "order_status", "delivery_time_days", "delivery_delay_days", "is_late", "purchase_year", "purchase_month", F.col("purchase_date").cast("string").alias("purchase_date"), "item_count",
        F.col("order_value").cast("double").alias("order_value"), "order_category", "customer_state", F.col("payment_total").cast("double").alias("payment_total"), "zip",
    )


@query("reviews_canonical", "SELECT review_id, review_score, review_text, has_title, has_message FROM e_canonical")
def reviews_canonical(s, d):
    return enrich.canonical_reviews(V.reviews(s, d), V.links(s, d)).select("review_id", "review_score", "review_text", "has_title", "has_message")


@query("review_metadata_unanimous", "SELECT * FROM e_meta")
def review_metadata_unanimous(s, d):
    x = enriched_reviews(s, d)
    return x.select("review_id", "linked_order_count", text_list("linked_order_ids").alias("linked_order_ids"), "product_category", "customer_state", "order_status", "purchase_year", "purchase_month")


@query("reviews_enriched", "SELECT review_id, review_score, text_is_eligible, has_title, has_message, linked_order_count, product_category, customer_state, order_status, purchase_year, purchase_month, sha256(coalesce(review_text, '')) AS text_hash FROM e_reviews")
def reviews_enriched(s, d):
    x = enriched_reviews(s, d)
    return x.select("review_id", "review_score", "text_is_eligible", "has_title", "has_message", "linked_order_count", "product_category", "customer_state", "order_status", "purchase_year", "purchase_month", F.sha2(F.coalesce("review_text", F.lit("")), 256).alias("text_hash"))


def _language_sql(lists: dict[str, str] = S.STOP_WORDS, unknown: str = "unknown") -> str:
    hits = {k: "len(list_intersect(words, [" + ", ".join(f"'{w}'" for w in v.split()) + "]))" for k, v in lists.items()}
    cols = ", ".join(f"{h} AS h_{k}" for k, h in hits.items())
    best = "greatest(" + ", ".join(f"h_{k}" for k in hits) + ")"
    ties = " + ".join(f"(CASE WHEN h_{k} = {best} THEN 1 ELSE 0 END)" for k in hits)
    pick = " ".join(f"WHEN h_{k} = {best} THEN '{k}'" for k in sorted(hits))
    return f"""SELECT doc_id, CASE WHEN n < 3 OR {best} < 2 OR {ties} > 1 THEN '{unknown}' {pick} END AS language FROM (SELECT doc_id, len(words) AS n, {cols} FROM (
      SELECT doc_id, list_filter(list_distinct(string_split({_PLAIN.format(c='text')}, ' ')), lambda w: length(w) > 1) AS words FROM documents))"""


@query("language_scores", _language_sql(), False)
def language_scores(s, d):
    return table(s, d, "documents").select("doc_id", S.language(F.col("text")).alias("language"))


@query("review_language", _language_sql(S.REVIEW_WORDS, S.UNKNOWN), False)
def review_language(s, d):
    return table(s, d, "documents").select("doc_id", S.review_language(F.col("text")).alias("language"))


@query("language_counts", f"SELECT language, count(*) AS n FROM ({_language_sql(S.REVIEW_WORDS, S.UNKNOWN)}) GROUP BY 1", False)
def language_counts(s, d):
    return eda.counts_by(review_language(s, d), "language")


@query("flattened_products", f""", l AS (SELECT review_id, unnest(string_split(product_ids, ',')) AS p FROM d_links JOIN e_items USING (order_id))
SELECT review_id, count(DISTINCT p) AS product_count, CASE WHEN count(DISTINCT p) = 1 THEN min(p) END AS only_product FROM l GROUP BY 1""")
def flattened_products(s, d):
    rows = V.links(s, d).join(enrich.items_by_order(V.items(s, d)).select("order_id", "product_ids"), "order_id")
    sets = rows.groupBy("review_id").agg(S.flattened_set(F.col("product_ids")).alias("p"))
    return sets.select("review_id", F.size("p").cast("long").alias("product_count"), F.when(F.size("p") == 1, F.element_at("p", 1).cast("string")).alias("only_product"))


# --- exploration --------------------------------------------------------------------------------------------------


@query("rating_distribution", "SELECT review_score, count(*) AS review_count, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM e_reviews GROUP BY 1")
def rating_distribution(s, d):
    return eda.rating_distribution(enriched_reviews(s, d))


_CATEGORY_SQL = f"""SELECT product_category, count(*) AS review_count, CAST(sum(review_score) AS DOUBLE) / nullif(count(review_score), 0) AS average_rating, CAST(sum(negative) AS DOUBLE) / count(*) AS negative_rate,
  CAST(count(*) FILTER (text_is_eligible) AS DOUBLE) / count(*) AS text_coverage, count(*) >= {LEAST} AS is_eligible FROM e_reviews WHERE product_category IS NOT NULL GROUP BY 1"""


@query("category_statistics", _CATEGORY_SQL)
def category_statistics(s, d):
    return eda.category_statistics(enriched_reviews(s, d), LEAST)


@query("topk_categories", f"SELECT * FROM ({_CATEGORY_SQL}) WHERE is_eligible ORDER BY negative_rate DESC, product_category LIMIT 15")
def topk_categories(s, d):
    return eda.top_categories(category_statistics(s, d))


@query("monthly_reviews_trailing", _MONTHLY + f"SELECT {_MONTHLY_COLUMNS} FROM mm")
def monthly_reviews_trailing(s, d):
    return eda.monthly_reviews(enriched_reviews(s, d), LEAST)


@query("worst_month", _MONTHLY + f"SELECT {_MONTHLY_COLUMNS} FROM mm WHERE rating_variation IS NOT NULL ORDER BY rating_variation, month LIMIT 1")
def worst_month(s, d):
    return eda.worst_month(monthly_reviews_trailing(s, d))


_DELAY_ALL = "CAST(delivery_delay_days AS DECIMAL(18,3))"


@query("monthly_orders", f"""SELECT CAST(date_trunc('month', purchase_date) AS DATE) AS month, count(DISTINCT order_id) AS order_count, {_dec_mean('order_value', 'order_value')} AS average_order_value,
  CAST(count(*) FILTER (is_late) AS DOUBLE) / nullif(count(is_late), 0) AS late_rate, {_dec_mean(_DELAY_ALL, _DELAY_ALL, 'DECIMAL(18,3)')} AS average_delay_days FROM e_orders GROUP BY 1""")
def monthly_orders(s, d):
    return eda.monthly_orders(enriched_orders(s, d))


_TOOK = "CAST(delivery_time_days AS DECIMAL(18,3))"


@query("delivery_by_rating", f"""SELECT review_score, count(*) AS review_count, CAST(count(*) FILTER (is_late) AS DOUBLE) / nullif(count(is_late), 0) AS late_rate,
  {_dec_mean(_TOOK, _TOOK, 'DECIMAL(18,3)')} AS average_delivery_days, {_dec_mean(_DELAY, _DELAY, 'DECIMAL(18,3)')} AS average_late_delay
  FROM e_reviews JOIN d_links USING (review_id) JOIN e_orders0 USING (order_id) WHERE linked_order_count = 1 GROUP BY 1""")
def delivery_by_rating(s, d):
    return eda.delivery_by_rating(enriched_reviews(s, d), V.links(s, d), enrich.with_delivery(V.orders(s, d)))


@query("status_share", "SELECT order_status AS status, count(*) AS order_count, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER () AS share FROM d_orders GROUP BY 1")
def status_share(s, d):
    return kpi.status_distribution(V.orders(s, d))


@query("geography_statistics", "SELECT customer_state, count(DISTINCT order_id) AS order_count, CAST(CAST(sum(order_value) AS DECIMAL(18,2)) AS DOUBLE) AS order_value, CAST(count(*) FILTER (is_late) AS DOUBLE) / nullif(count(is_late), 0) AS late_rate FROM e_orders GROUP BY 1")
def geography_statistics(s, d):
    return eda.geography(enriched_orders(s, d))


@query("text_coverage", "SELECT review_score, count(*) AS review_count, count(*) FILTER (text_is_eligible) AS text_count, CAST(count(*) FILTER (text_is_eligible) AS DOUBLE) / count(*) AS text_coverage FROM e_reviews GROUP BY 1")
def text_coverage(s, d):
    return eda.text_coverage(enriched_reviews(s, d))


@query("scalar_summary", """SELECT r.*, o.* FROM (SELECT count(*) AS reviews, count(review_score) AS scored_reviews, CAST(sum(negative) AS BIGINT) AS negative_reviews, count(*) FILTER (text_is_eligible) AS text_reviews,
  count(*) FILTER (text_is_eligible AND negative = 1) AS negative_text_reviews, CAST(sum(review_score) AS DOUBLE) / count(review_score) AS average_rating FROM e_reviews) r,
  (SELECT count(*) AS orders, count(*) FILTER (is_late) AS late_orders, count(is_late) AS delivered_orders, CAST(CAST(sum(order_value) AS DECIMAL(18,2)) AS DOUBLE) AS total_value, count(DISTINCT customer_id) AS customers FROM e_orders) o""")
def scalar_summary(s, d):
    return eda.scalar_summary(enriched_reviews(s, d), enriched_orders(s, d))


# --- themes -------------------------------------------------------------------------------------------------------

_SENTENCES = [
    "Ainda não recebi e quero reembolso", "Produto quebrado e com defeito", "ru", "Embalagem sem manual adequado e instruções confusas", "Produto excelente e entrega perfeita",
    "Recebi o produto no prazo mas veio com defeito", "O prazo já passou e ainda não recebi", "Produto de qualidade, recomendo", "Fiz um pedido e recebi outro totalmente diferente",
    "Pedi reembolso e até agora não recebi o dinheiro", "O produto chegou quebrado e já postei devolvendo", "faltará uma peça",
]
_PLANTED = "[" + ", ".join(f"'{t}'" for t in _SENTENCES) + f"][doc_id % {len(_SENTENCES)} + 1]"


def _sentences(s: SparkSession, d: str, version: str) -> DataFrame:
    """Every document with a sentence of the language the rules are for before its text, each third one alone."""
    planted = F.element_at(F.array(*[F.lit(t) for t in _SENTENCES]), (F.col("doc_id") % len(_SENTENCES) + 1).cast("int"))
    text = F.when(F.col("doc_id") % 3 == 0, planted).otherwise(F.concat(planted, F.lit(" "), F.coalesce("text", F.lit(""))))
    rows = themes.with_theme_array(table(s, d, "documents").select("doc_id", text.alias("text")), F.col("text"), version)
    return rows.select("doc_id", F.array_join(F.sort_array("themes"), ",").alias("themes"))


for _name, _version, _rules, _positive in (("themes_rules_v2", "rules-pt-v2", R.RULES_V2, False), ("themes_rules_v3", "rules-pt-v3", R.RULES_V3, True)):
    query(_name, f"SELECT doc_id, list_aggregate(list_sort({_sql_theme_array(_rules, _positive)}), 'string_agg', ',') AS themes FROM (SELECT doc_id, {_PLAIN.format(c='t')} AS plain FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN {_PLANTED} ELSE {_PLANTED} || ' ' || coalesce(text, '') END AS t FROM documents))", False)(
        lambda s, d, v=_version: _sentences(s, d, v)
    )

_NEG = "SELECT * FROM e_rag WHERE rag AND negative = 1"


@query("review_themes", "SELECT review_id, review_score, theme FROM e_themes")
def review_themes(s, d):
    return synthetic_themes(s, d).select("review_id", "review_score", "theme")


_EDA_THEMES = f"SELECT review_id, theme FROM (SELECT review_id, unnest({_sql_theme_array(R.RULES_SYNTHETIC, False)}) AS theme FROM e_reviews WHERE negative = 1 AND text_is_eligible)"


@query("eda_themes", _EDA_THEMES)
def eda_themes(s, d):
    return themes.classify_negative(enriched_reviews(s, d), R.RULES_SYNTHETIC).select("review_id", "theme")


@query("theme_counts", f"SELECT theme, count(DISTINCT review_id) AS mentions FROM ({_NEG}) JOIN e_themes USING (review_id) GROUP BY 1")
def theme_counts(s, d):
    return themes.counts(annotated_reviews(s, d))


@query("theme_prevalence", f"SELECT theme, count(DISTINCT review_id) AS review_count, CAST(count(DISTINCT review_id) AS DOUBLE) / nullif((SELECT count(*) FROM ({_NEG})), 0) AS prevalence FROM ({_NEG}) JOIN e_themes USING (review_id) GROUP BY 1")
def theme_prevalence(s, d):
    return themes.prevalence(annotated_reviews(s, d))


def _by_sql(*by: str) -> str:
    keys, known = ", ".join(by), " AND ".join(f"{b} IS NOT NULL" for b in by)
    return f"""SELECT {keys}, theme, review_count, n AS negative_text_reviews, CAST(review_count AS DOUBLE) / n AS share FROM
      (SELECT {keys}, theme, count(DISTINCT review_id) AS review_count FROM ({_NEG} AND {known}) JOIN e_themes USING (review_id) GROUP BY ALL) JOIN (SELECT {keys}, count(*) AS n FROM ({_NEG} AND {known}) GROUP BY ALL) USING ({keys})"""


@query("themes_by_category", _by_sql("product_category"))
def themes_by_category(s, d):
    return themes.themes_by(annotated_reviews(s, d), "product_category")


@query("themes_by_month", _by_sql("purchase_year", "purchase_month"))
def themes_by_month(s, d):
    return themes.themes_by(annotated_reviews(s, d), "purchase_year", "purchase_month")


@query("theme_population", """SELECT count(*) AS total_reviews, count(*) FILTER (rag) AS text_reviews, CAST(sum(negative) AS BIGINT) AS negative_reviews, count(*) FILTER (rag AND negative = 1) AS negative_text_reviews,
  CAST(count(*) FILTER (rag) AS DOUBLE) / count(*) AS text_coverage, CAST(count(*) FILTER (rag AND negative = 1) AS DOUBLE) / nullif(sum(negative), 0) AS negative_text_coverage FROM e_rag""")
def theme_population(s, d):
    return themes.population(enriched_reviews(s, d))


_LONG_PERIOD = kpi.Filters(start_month="1995-06", end_month="2001-12")
_EVIDENCE = f"""
, t AS (SELECT review_id, CASE WHEN purchase_year * 12 + purchase_month >= 1995*12+6 THEN 'c' ELSE 'b' END AS w FROM ({_NEG}) WHERE purchase_year * 12 + purchase_month BETWEEN 1995*12+3 AND 2001*12+12),
h AS (SELECT theme, count(DISTINCT review_id) FILTER (w = 'c') AS c, count(DISTINCT review_id) FILTER (w = 'b') AS b FROM t JOIN e_themes USING (review_id) GROUP BY 1),
n AS (SELECT count(*) FILTER (w = 'c') AS nc, count(*) FILTER (w = 'b') AS nb FROM t),
ev AS (SELECT theme, coalesce(c, 0) AS current_mentions, CAST(coalesce(c, 0) AS DOUBLE) / nullif(nc, 0) AS current_rate, coalesce(b, 0) AS baseline_mentions, CAST(coalesce(b, 0) AS DOUBLE) / nullif(nb, 0) AS baseline_rate,
  CAST(coalesce(c, 0) AS DOUBLE) / nullif(nc, 0) - CAST(coalesce(b, 0) AS DOUBLE) / nullif(nb, 0) AS rate_change, theme NOT IN ('other', 'uncertain') AS is_candidate
  FROM (VALUES {", ".join(f"('{t}')" for t in R.THEMES)}) v(theme) LEFT JOIN h USING (theme), n)
"""


@query("theme_evidence", _EVIDENCE + "SELECT * FROM ev")
def theme_evidence(s, d):
    return themes.evidence(annotated_reviews(s, d), _LONG_PERIOD)


@query("theme_ranked", _EVIDENCE + "SELECT *, CAST(row_number() OVER (ORDER BY coalesce(rate_change, current_rate) DESC, current_rate DESC, current_mentions DESC, theme) AS INTEGER) AS rank FROM ev WHERE is_candidate AND current_mentions > 0")
def theme_ranked(s, d):
    return themes.ranked(theme_evidence(s, d))


@query("meaningful_text", "SELECT review_id, rag FROM e_rag")
def meaningful_text(s, d):
    return enriched_reviews(s, d).select("review_id", F.coalesce(themes.rag_eligible(), F.lit(False)).alias("rag"))


# --- documents ----------------------------------------------------------------------------------------------------

_THEME_SET = "(SELECT review_id, list_aggregate(list_sort(list(theme)), 'string_agg', ',') AS themes FROM e_themes GROUP BY 1)"
_DOCS = f"""
, docs AS (SELECT 'review_' || review_id AS document_id, review_id, review_score, product_category, customer_state, order_status, coalesce(themes, '') AS themes,
  CASE WHEN has_title AND has_message THEN 'title_and_message' WHEN has_title THEN 'title' WHEN has_message THEN 'message' END AS text_source,
  purchase_year * 12 + purchase_month AS purchase_month_index, CASE WHEN purchase_year * 12 + purchase_month IS NOT NULL THEN format('{{:04d}}-{{:02d}}', purchase_year, purchase_month) END AS purchase_month,
  CASE WHEN has_title AND has_message THEN 'Title: ' || trim(title) || chr(10) || 'Comment: ' || trim(message) WHEN has_title THEN 'Title: ' || trim(title) ELSE 'Comment: ' || trim(message) END AS document_text
  FROM e_rag LEFT JOIN {_THEME_SET} USING (review_id) WHERE rag),
meta AS (SELECT *, sha256(document_text) AS document_hash, sha256(concat_ws('|', 'customer_state=' || coalesce(customer_state, 'null'), 'order_status=' || coalesce(order_status, 'null'),
  'product_category=' || coalesce(product_category, 'null'), 'purchase_month_index=' || coalesce(CAST(purchase_month_index AS VARCHAR), 'null'), 'review_score=' || coalesce(CAST(review_score AS VARCHAR), 'null'),
  'text_source=' || coalesce(text_source, 'null'), 'themes_csv=' || themes)) AS metadata_hash FROM docs)
"""


def rag_docs(s: SparkSession, d: str) -> DataFrame:
    return D.with_metadata(D.build(annotated_reviews(s, d)))


@query("rag_documents", _DOCS + "SELECT document_id, review_score, product_category, customer_state, themes, text_source, purchase_month_index, purchase_month, document_hash FROM meta")
def rag_documents(s, d):
    return rag_docs(s, d).select("document_id", "review_score", "product_category", "customer_state", F.col("themes_csv").alias("themes"), "text_source", "purchase_month_index", "purchase_month", "document_hash")


@query("document_metadata", _DOCS + "SELECT document_id, metadata_hash, " + ", ".join(f"contains(',' || themes || ',', ',{t},') AS theme_{t}" for t in R.THEMES) + " FROM meta")
def document_metadata(s, d):
    return rag_docs(s, d).select("document_id", "metadata_hash", *[f"theme_{t}" for t in R.THEMES])


@query("document_contract", _DOCS + """, p AS (SELECT count(*) FILTER (review_id % 31 = 0) AS twice, count(*) FILTER (review_id % 29 = 0) AS lost, count(*) FILTER (review_id % 29 = 0 AND review_id % 31 = 0) AS both_,
  count(*) FILTER (review_id % 29 <> 0 AND review_id % 37 = 0) + count(*) FILTER (review_id % 29 <> 0 AND review_id % 37 = 0 AND review_id % 31 = 0) AS blank,
  count(*) FILTER (review_id % 29 <> 0 AND review_id % 41 = 0) + count(*) FILTER (review_id % 29 <> 0 AND review_id % 41 = 0 AND review_id % 31 = 0) AS bare FROM docs)
SELECT twice - both_ AS duplicate_ids, blank AS empty_texts, bare AS missing_themes, lost - (twice - both_) AS missing_documents FROM p""")
def document_contract(s, d):
    """The contract's counts for documents with planted faults: some lost, some twice, some without text or themes."""
    i = F.col("review_id")
    docs = rag_docs(s, d).where(i % 29 != 0)
    docs = docs.withColumns({"document_text": F.when(i % 37 != 0, F.col("document_text")), "themes": F.when(i % 41 == 0, F.array().cast("array<string>")).otherwise(F.col("themes"))})
    return D.contract_violations(docs.unionByName(docs.where(i % 31 == 0)), enriched_reviews(s, d))


@query("text_source_counts", _DOCS + "SELECT text_source, count(*) AS n FROM docs GROUP BY 1")
def text_source_counts(s, d):
    return rag_docs(s, d).groupBy("text_source").agg(F.count(F.lit(1)).alias("n"))


@query("index_sync_actions", _DOCS + """SELECT document_id, CASE WHEN review_id % 11 = 0 THEN 'upsert' WHEN review_id % 13 = 0 THEN 'upsert' WHEN review_id % 17 = 0 THEN 'update_metadata' ELSE 'skip' END AS action FROM meta
  UNION ALL SELECT 'gone_' || review_id, 'delete' FROM meta WHERE review_id % 50 = 0""")
def index_sync_actions(s, d):
    return D.sync_actions(*_index_sides(s, d))


def _wanted(s: SparkSession, d: str) -> DataFrame:
    """What an index compares of the documents: written once, as both sides and every step of a synchronisation read it."""
    return written(rag_docs(s, d).select("document_id", "review_id", "document_hash", "metadata_hash"), "wanted")


def _index_sides(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Wanted documents, and an index in which some are missing, some have old text or metadata, and some are stale."""
    wanted = _wanted(s, d)
    i = F.col("review_id")
    old = wanted.where(i % 11 != 0).withColumns({"document_hash": F.when(i % 13 == 0, "old").otherwise(F.col("document_hash")), "metadata_hash": F.when(i % 17 == 0, "old").otherwise(F.col("metadata_hash"))})
    gone = wanted.where(i % 50 == 0).withColumn("document_id", F.concat(F.lit("gone_"), i.cast("string")))
    return wanted, old.select("document_id", "document_hash", "metadata_hash").unionByName(gone.select("document_id", "document_hash", "metadata_hash"))


@query("index_sync_summary", _DOCS + """, m AS (SELECT review_id % 11 = 0 OR review_id % 13 = 0 AS up, review_id % 17 = 0 AS meta_, review_id % 11 = 0 AS fresh, review_id % 50 = 0 AS gone FROM meta)
SELECT count(*) AS documents_expected, count(*) FILTER (NOT fresh) + count(*) FILTER (gone) AS documents_existing_before, count(*) FILTER (up) AS documents_upserted, count(*) FILTER (NOT up AND meta_) AS documents_metadata_updated,
  count(*) FILTER (NOT up AND NOT meta_) AS documents_skipped_unchanged, count(*) FILTER (gone) AS stale_documents_removed, count(*) AS documents_after FROM m""")
def index_sync_summary(s, d):
    return index.sync_summary(*_index_sides(s, d))


@query("index_applied", _DOCS + """ SELECT document_id, metadata_hash, CASE WHEN review_id % 11 = 0 OR review_id % 13 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS vector FROM meta""")
def index_applied(s, d):
    """The index after a synchronisation; stored vectors are 0.5, new ones 1."""
    wanted, old = _index_sides(s, d)
    stored = old.withColumn("embedding", F.array(F.lit(0.5)))
    done = index.applied(wanted.select("document_id", "document_hash", "metadata_hash"), stored, lambda rows: rows.withColumn("embedding", F.array(F.lit(1.0))), "hashed words", "1")
    return done.select("document_id", "metadata_hash", F.col("embedding")[0].cast("double").alias("vector"))


#: Buckets of the stored index in ``index_bucket_sync``, and those among them in which documents change.
_BUCKETS, _CHANGED = 64, 3


@query("index_bucket_sync", _DOCS + f""", b AS (SELECT *, ('0x' || substr(md5(document_id), 1, 8))::BIGINT % {_BUCKETS} AS bucket FROM meta),
a AS (SELECT *, bucket < {_CHANGED} AND review_id % 3 = 0 AS added, bucket < {_CHANGED} AND review_id % 3 = 1 AS other FROM b), t AS (SELECT bucket, bool_or(added OR other) AS touched FROM a GROUP BY 1)
SELECT document_id, metadata_hash, CASE WHEN added THEN 1.0 ELSE 0.5 END::DOUBLE AS vector, CASE WHEN touched THEN 2 ELSE 1 END::BIGINT AS written FROM a JOIN t USING (bucket)""")
def index_bucket_sync(s, d):
    """A stored index after a synchronisation in which documents of three buckets were added or changed: those buckets' files
    are of the second version, all others of the first. Stored vectors are 0.5, new ones 1."""
    at = BucketTable(s, f"{shared_folder(s)}/index-{uuid.uuid4().hex}", "document_id", _BUCKETS)
    wanted = _wanted(s, d)
    few, i = at.bucket_of(_BUCKETS) < _CHANGED, F.col("review_id")
    old = wanted.where(~(few & (i % 3 == 0))).withColumn("metadata_hash", F.when(few & (i % 3 == 1), "old").otherwise(F.col("metadata_hash")))
    embed = lambda value: lambda rows: rows.withColumn("embedding", F.array(F.lit(value)))
    index.synchronise_buckets(old, at, embed(0.5), "hashed words", "1")
    index.synchronise_buckets(wanted, at, embed(1.0), "hashed words", "1")
    number = F.regexp_extract(F.input_file_name(), "/data/([0-9]+)-[0-9a-f]+/bucket=", 1).cast("long")
    return at.read().select("document_id", "metadata_hash", F.col("embedding")[0].cast("double").alias("vector"), number.alias("written"))


# --- retrieval ----------------------------------------------------------------------------------------------------


def _query_vector(s: SparkSession, d: str) -> list[float]:
    return list(table(s, d, "embeddings").orderBy("vec_id").select("embedding").first()[0])


_COS = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
_TOP = "SELECT *, CAST(row_number() OVER (ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM (SELECT a.vec_id, a.label, {cos} AS similarity FROM embeddings a, (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1) b WHERE {where} ORDER BY similarity DESC, a.vec_id LIMIT {k})"


@query("vector_topk", _TOP.format(cos=_COS, where="true", k=10), False)
def vector_topk(s, d):
    return retrieval.top_k(table(s, d, "embeddings"), _query_vector(s, d), 10)


@query("filtered_documents", _DOCS + """ SELECT document_id FROM meta WHERE review_score <= 2 AND customer_state = 'CHINA' AND purchase_month_index BETWEEN 1996 * 12 + 1 AND 1999 * 12 + 12""")
def filtered_documents(s, d):
    filters = retrieval.RetrievalFilters(state="China", first_month=1996 * 12 + 1, last_month=1999 * 12 + 12, max_score=2)
    return rag_docs(s, d).where(filters.predicate()).select("document_id")


@query("theme_documents", _DOCS + " SELECT document_id FROM meta WHERE list_contains(string_split(themes, ','), 'delivery_delay')")
def theme_documents(s, d):
    return rag_docs(s, d).where(retrieval.RetrievalFilters(theme="delivery_delay").predicate()).select("document_id")


@query("lexical_overlap", f"""SELECT doc_id, round(len(list_intersect(string_split({_PLAIN.format(c='text')}, ' '), ['the', 'and', 'of', 'de', 'la'])) / 5.0::DOUBLE, 6) AS score FROM documents""", False)
def lexical_overlap(s, d):
    return table(s, d, "documents").select("doc_id", retrieval.lexical_overlap(F.col("text"), "the and of de la the").alias("score"))


@query("folded_accents", "SELECT doc_id, sha256(translate(lower(text), 'àáâãäèéêëìíîïòóôõöùúûüçñ', 'aaaaaeeeeiiiiooooouuuucn')) AS hash FROM documents", False)
def folded_accents(s, d):
    return table(s, d, "documents").select("doc_id", F.sha2(S.fold_accents(F.lower("text")), 256).alias("hash"))


@query("vector_topk_filtered", _TOP.format(cos=_COS, where="a.label <= 3", k=10), False)
def vector_topk_filtered(s, d):
    return retrieval.top_k(table(s, d, "embeddings"), _query_vector(s, d), 10, F.col("label") <= 3)


@query("rerank_topk", f"SELECT *, CAST(row_number() OVER (ORDER BY rerank_score DESC, similarity DESC, vec_id) AS INTEGER) AS reranked_rank FROM (SELECT *, CAST(vec_id % 7 AS DOUBLE) AS rerank_score FROM ({_TOP.format(cos=_COS, where='true', k=50)})) QUALIFY reranked_rank <= 5", False)
def rerank_topk(s, d):
    return retrieval.rerank(retrieval.top_k(table(s, d, "embeddings"), _query_vector(s, d), 50), (F.col("vec_id") % 7).cast("double"), 5)


#: Every vector whose id is divisible by this is a query.
QUERY_STEP = 20


def _query_set(s: SparkSession, d: str) -> DataFrame:
    some = table(s, d, "embeddings").where(F.col("vec_id") % QUERY_STEP == 0)
    return some.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query"))


def _results(s: SparkSession, d: str, k: int = 5, only: F.Column | None = None) -> DataFrame:
    queries = _query_set(s, d)
    return retrieval.top_k_each(table(s, d, "embeddings"), queries if only is None else queries.where(only), k)


_EACH = f"""WITH q AS (SELECT * FROM embeddings WHERE vec_id % {QUERY_STEP} = 0),
res AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER) AS rank FROM
  (SELECT b.vec_id AS query_id, b.label AS query_label, a.vec_id, a.label, {_COS} AS similarity FROM embeddings a, q b WHERE a.vec_id <> b.vec_id) QUALIFY rank <= 5)"""


@query("vector_topk_each", _EACH + " SELECT * FROM res", False)
def vector_topk_each(s, d):
    return _results(s, d)


@query("ivf_topk_each", _EACH + " SELECT * FROM res", False)
def ivf_topk_each(s, d):
    """The exact mode of the inverted-file search: no cell left can hold a nearer vector."""
    return ivf.search(ivf.build(table(s, d, "embeddings")), _query_set(s, d), 5, exact=True)


@query("ivf_filtered_each", _EACH.replace("a.vec_id <> b.vec_id", "a.vec_id <> b.vec_id AND a.label <= 3 AND a.vec_id % 3 = 0") + " SELECT * FROM res", False)
def ivf_filtered_each(s, d):
    """The same under a filter that few rows of a cell pass: the search widens until it has enough."""
    return ivf.search(ivf.build(table(s, d, "embeddings")), _query_set(s, d), 5, (F.col("label") <= 3) & (F.col("vec_id") % 3 == 0), exact=True)


@query("retrieve_per_theme", _EACH + """, c AS (SELECT CAST(vec_id AS VARCHAR) AS document_id, query_id AS theme, CAST(query_id // 20 + 1 AS INTEGER) AS theme_rank, similarity FROM res),
t AS (SELECT *, CAST(row_number() OVER (PARTITION BY theme ORDER BY similarity DESC, document_id) AS INTEGER) AS rn FROM c WHERE theme_rank <= 3 QUALIFY rn <= 2)
SELECT * FROM t QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY theme_rank, rn) = 1""", False)
def retrieve_per_theme(s, d):
    place = (F.expr(f"query_id div {QUERY_STEP}") + 1).cast("int")  # of the query among all
    c = _results(s, d, only=place <= 3).select(F.col("vec_id").cast("string").alias("document_id"), F.col("query_id").alias("theme"), place.alias("theme_rank"), "similarity")
    return retrieval.per_theme(c)


_SOURCES, _TARGETS = ("cobre-leito bonito", "um Cobre leito vermelho", "cama", "cobre leito"), ("Rame-letto bello", "un rame letto rosso", "rame-letto", None)


@query("glossary_fix", f"""SELECT doc_id, sha256(CASE WHEN regexp_matches(source, '(?i)\\bcobre(?:-|\\s+)leito\\b') THEN regexp_replace(regexp_replace(t, '\\br(?i:ame(?:-|\\s+)letto)\\b', 'copriletto', 'g'), '\\bR(?i:ame(?:-|\\s+)letto)\\b', 'Copriletto', 'g') ELSE t END) AS fixed_sha256
FROM (SELECT doc_id, {list(_SOURCES)}[doc_id % 4 + 1] || ' ' || coalesce(text, '') AS source, [{", ".join("NULL" if t is None else f"'{t}'" for t in _TARGETS)}][doc_id % 4 + 1] || ' ' || coalesce(text, '') AS t FROM documents)""", False)
def glossary_fix(s, d):
    """Every document as a translation with a planted word, wrong in three of four, and its source."""
    planted = lambda words: F.concat(F.element_at(F.array(*[F.lit(t) for t in words]), (F.col("doc_id") % 4 + 1).cast("int")), F.lit(" "), F.coalesce("text", F.lit("")))
    rows = table(s, d, "documents").select("doc_id", planted(_SOURCES).alias("source"), planted(_TARGETS).alias("translation"))
    return rows.select("doc_id", F.sha2(retrieval.glossary_fix(F.col("source"), F.col("translation")), 256).alias("fixed_sha256"))


_QUESTIONS = [
    "Perch\u00e9 il rating medio è sceso a marzo 2018 per i mobili per ufficio?", "Quali problemi citano le recensioni negative su LETTO BAGNO e tavola tra 2017-11 e 2018-02?",
    "Qual è il volume ordini di informatica_e_accessori?", "I ritardi di consegna incidono sulla valutazione? gennaio 2018 e dicembre 2017", "Perché aumentano le recensioni negative per prodotto incompleto e rimborso?",
    "Qual è il valore medio degli ordini di profumi?", "",
]
_names = lambda rows: ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
_subject = lambda name: " AND ".join("(" + " OR ".join(f"contains(p, '{stem}')" for stem in group) + ")" for group in answers.STEMS[name]) + (" OR theme IS NOT NULL" if name == "complaint" else "")
_asked = " ".join(f"WHEN {' OR '.join('(' + ' AND '.join(f'({_subject(n)})' for n in c) + ')' for c in choices)} THEN ['{i}', '{m}']" for i, m, *choices in answers.ASKED)
_MONTH = f"({'|'.join(answers.MONTHS)})"


@query("questions_interpreted", f"""WITH q AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n, [{", ".join(f"'{x}'" for x in _QUESTIONS)}][(conv_id + turn) % {len(_QUESTIONS)} + 1] || ' ' || coalesce(text, '') AS text FROM conversations),
f AS (SELECT *, strip_accents(lower(text)) AS p FROM q),
c(name, place, category) AS (VALUES {_names((n, k, c) for k, (n, c) in enumerate(answers.CATEGORIES.items()))}), t(name, theme) AS (VALUES {_names((n, t) for t, names in answers.THEME_NAMES.items() for n in names)}),
cats AS (SELECT conv_id, turn, n, max_by(category, length(name) * 1000 - place) AS category FROM f JOIN c ON contains(replace(p, '_', ' '), name) GROUP BY ALL),
ths AS (SELECT conv_id, turn, n, max([lpad(CAST(length(name) AS VARCHAR), 4, '0'), theme])[2] AS theme FROM f JOIN t ON contains(p, name) GROUP BY ALL),
m AS (SELECT *, regexp_extract_all(text, '\\b(?:19|20)[0-9]{{2}}-(?:0[1-9]|1[0-2])\\b') AS iso, regexp_extract_all(p, '\\b{_MONTH}\\s+(?:19|20)[0-9]{{2}}\\b') AS named FROM f LEFT JOIN cats USING (conv_id, turn, n) LEFT JOIN ths USING (conv_id, turn, n)),
d AS (SELECT *, CASE WHEN len(iso) > 0 THEN iso ELSE list_transform(named, lambda x: right(x, 4) || '-' || lpad(CAST(list_position({answers.MONTHS}, regexp_extract(x, '^[a-z]+')) AS VARCHAR), 2, '0')) END AS months, CASE {_asked} ELSE ['unsupported', 'unknown'] END AS asked FROM m)
SELECT conv_id, turn, asked[1] AS intent, asked[2] AS metric, theme, category, months[1] AS start_month, coalesce(months[2], months[1]) AS end_month, coalesce(months[1] <= coalesce(months[2], months[1]), true) AS valid FROM d WHERE trim(text) <> ''
UNION ALL SELECT conv_id, turn, NULL, NULL, NULL, NULL, NULL, NULL, false FROM d WHERE trim(text) = ''""", False)
def questions_interpreted(s, d):
    """Every turn behind a planted question (six of seven turns): what it asks for."""
    planted = F.element_at(F.array(*[F.lit(q) for q in _QUESTIONS]), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_QUESTIONS))) + 1).cast("int"))
    rows = table(s, d, "conversations").select("conv_id", "turn", F.concat(planted, F.lit(" "), F.coalesce("text", F.lit(""))).alias("text"))
    return questions.interpret_table(rows).select("conv_id", "turn", "question.*")


@query("translations_stored", """SELECT doc_id, sha256(translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')) AS translated_sha256, CASE WHEN text IS NULL THEN 'empty' WHEN EXISTS (SELECT 1 FROM documents o WHERE o.text = d.text AND o.doc_id % 2 = 0) THEN 'cached' ELSE 'translated' END AS status FROM documents d""", False)
def translations_stored(s, d):
    """All texts translated with a stored cache that already has those of even ids; translations are upper-cased A-Z."""
    cache = BucketTable(s, f"{shared_folder(s)}/translations-{uuid.uuid4().hex}", "source_hash", 32)
    rows = table(s, d, "documents").select("doc_id", F.col("text").alias("source_text"))
    capitals = {k: k - 32 for k in range(97, 123)}
    translator = lambda t: t.translate(capitals)
    retrieval.translate_stored(rows.where("doc_id % 2 = 0"), cache, translator, "1", "it")
    done, _ = retrieval.translate_stored(rows, cache, translator, "1", "it")
    return done.select("doc_id", F.sha2("translated_text", 256).alias("translated_sha256"), "status")


@query("hash_embedding", """, w AS (SELECT doc_id, unnest([('0x' || substr(sha256(w), 1, 8))::BIGINT % 128 for w in string_split(plain, ' ') if w <> '']) AS slot
  FROM (SELECT doc_id, """.replace(", w AS", "WITH w AS", 1) + _PLAIN.format(c="text") + """ AS plain FROM documents)), n AS (SELECT doc_id, slot, count(*) AS n FROM w GROUP BY 1, 2)
SELECT doc_id, string_agg(slot, ',' ORDER BY slot) AS slots, string_agg(CAST(round(n / norm * 10000) AS BIGINT), ',' ORDER BY slot) AS parts FROM (SELECT *, sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS norm FROM n) GROUP BY 1""", False)
def hash_embedding(s, d):
    docs = table(s, d, "documents").where(S.letters_only(F.col("text")) != "").select("doc_id", retrieval.embed_hashed(F.col("text")).alias("e"))
    slots = F.filter(F.transform("e", lambda x, i: F.when(x > 0, F.struct(i.alias("slot"), F.round(x * 10000).cast("long").alias("part")))), lambda x: x.isNotNull())
    joined = lambda c: F.array_join(F.transform(slots, lambda x: x[c].cast("string")), ",").alias(c + "s")
    return docs.select("doc_id", joined("slot"), joined("part"))


# --- evaluation ---------------------------------------------------------------------------------------------------


def _ranked(results: DataFrame) -> DataFrame:
    return results.select("query_id", F.col("vec_id").alias("doc_id"), "rank")


def _relevant(results: DataFrame) -> DataFrame:
    """Of the found pairs those of one label: no other pair can be a hit."""
    return results.where("label = query_label").select("query_id", F.col("vec_id").alias("doc_id"))


def _relevant_counts(s: SparkSession, d: str) -> DataFrame:
    """For each query the vectors of its label under another id, counted without listing the pairs."""
    v = table(s, d, "embeddings")
    q = _query_set(s, d).select("query_id", "query_label")
    of_label = v.groupBy(F.col("label").alias("query_label")).agg(F.count("vec_id").alias("n"))
    own = v.groupBy(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label")).agg(F.count(F.lit(1)).alias("own"))
    return q.join(of_label, "query_label").join(own, ["query_id", "query_label"]).select("query_id", (F.col("n") - F.col("own")).alias("n_relevant"))


_REL = ", rel AS (SELECT b.vec_id AS query_id, a.vec_id AS doc_id FROM embeddings a JOIN q b ON a.label = b.label AND a.vec_id <> b.vec_id)"


@query("retrieval_metrics", _EACH + _REL + """, n AS (SELECT query_id, count(*) AS n FROM rel GROUP BY 1),
p AS (SELECT res.query_id, count(rel.doc_id) AS hits, max(CASE WHEN rel.doc_id IS NULL THEN 0.0 ELSE 1.0::DOUBLE / rank END) AS rr, sum(CASE WHEN rel.doc_id IS NULL THEN 0.0::DOUBLE ELSE 1.0 / log2(rank + 1.0::DOUBLE) END) AS dcg
  FROM res LEFT JOIN rel ON rel.query_id = res.query_id AND rel.doc_id = res.vec_id GROUP BY 1)
SELECT p.query_id, hits / 5.0::DOUBLE AS precision, coalesce(hits::DOUBLE / nullif(n, 0), 0) AS recall, CASE WHEN hits > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS hit, round(rr::DOUBLE, 9) AS reciprocal_rank,
  round(CASE WHEN n > 0 THEN dcg / list_sum([1.0::DOUBLE / log2(i + 1.0::DOUBLE) for i in range(1, least(n, 5) + 1)]) ELSE 0 END, 9) AS ndcg FROM p LEFT JOIN n USING (query_id)""", False)
def retrieval_metrics(s, d):
    r = _results(s, d)
    m = E.ranking_metrics(_ranked(r), _relevant(r), 5, _relevant_counts(s, d))
    return m.withColumns({"ndcg": F.round("ndcg", 9), "reciprocal_rank": F.round(F.col("reciprocal_rank").cast("double"), 9)})


def _labels(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    e = v.select(F.col("vec_id").alias("id"), F.explode(F.array(F.concat(F.lit("l"), (F.col("label") % 4).cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")))).alias("label"))
    p = v.select(F.col("vec_id").alias("id"), F.explode(F.array(F.concat(F.lit("l"), (F.col("label") % 5).cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string")))).alias("label"))
    return e, p


_LABELS = """WITH e AS (SELECT DISTINCT vec_id AS id, unnest(['l' || (label % 4), 'm' || (vec_id % 3)]) AS label FROM embeddings), p AS (SELECT DISTINCT vec_id AS id, unnest(['l' || (label % 5), 'm' || (vec_id % 3)]) AS label FROM embeddings)"""


@query("multilabel_metrics", _LABELS + """, c AS (SELECT label, count(*) FILTER (e.id IS NOT NULL AND p.id IS NOT NULL) AS tp, count(*) FILTER (e.id IS NULL) AS fp, count(*) FILTER (p.id IS NULL) AS fn, count(e.id) AS support FROM e FULL JOIN p USING (id, label) GROUP BY 1),
a AS (SELECT * FROM c UNION ALL SELECT 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), CAST(sum(support) AS BIGINT) FROM c),
m AS (SELECT label, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, support FROM a),
f AS (SELECT label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM m)
SELECT * FROM f UNION ALL SELECT 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f WHERE label <> 'micro'""", False)
def multilabel_metrics(s, d):
    return E.multilabel_metrics(*_labels(s, d))


@query("exact_match", _LABELS + " SELECT avg(CASE WHEN x = y THEN 1.0 ELSE 0.0 END)::DOUBLE AS exact_match FROM (SELECT id, list_sort(list(label)) AS x FROM e GROUP BY 1) JOIN (SELECT id, list_sort(list(label)) AS y FROM p GROUP BY 1) USING (id)", False)
def exact_match(s, d):
    return E.exact_match(*_labels(s, d))


@query("error_confusion", _LABELS + " SELECT label, count(*) FILTER (e.id IS NULL) AS false_positives, count(*) FILTER (p.id IS NULL) AS false_negatives FROM e FULL JOIN p USING (id, label) GROUP BY 1", False)
def error_confusion(s, d):
    return E.multilabel_counts(*_labels(s, d)).select("label", F.col("fp").alias("false_positives"), F.col("fn").alias("false_negatives"))


@query("kappa", """SELECT count(*) AS pairs, avg((quality = toxic)::INT)::DOUBLE AS agreement, (avg((quality = toxic)::INT) - (sum(quality) * sum(toxic) + (count(*) - sum(quality)) * (count(*) - sum(toxic)))::DOUBLE / (count(*) * count(*)))
  / (1 - (sum(quality) * sum(toxic) + (count(*) - sum(quality)) * (count(*) - sum(toxic)))::DOUBLE / (count(*) * count(*))) AS kappa FROM labels""", False)
def kappa_(s, d):
    return E.kappa(table(s, d, "labels"), "quality", "toxic")


@query("latency_percentiles", """, x AS (SELECT order_status, CAST(order_value AS DOUBLE) AS v, row_number() OVER (PARTITION BY order_status ORDER BY order_value) AS rn, count(*) OVER (PARTITION BY order_status) AS n FROM e_orders WHERE order_value IS NOT NULL)
SELECT order_status, count(*) AS n, CAST(CAST(sum(CAST(v AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS DOUBLE) / count(*) AS mean, median(v) AS median, max(v) FILTER (rn = round_even((n - 1) * 0.95::DOUBLE, 0) + 1) AS p95 FROM x GROUP BY 1""")
def latency_percentiles(s, d):
    rows = enriched_orders(s, d).where("order_value is not null").select("order_status", F.col("order_value").cast("double").alias("v"))
    return E.latency_summary(rows, "order_status", "v")


_JUDGED = ", judged AS (SELECT b.vec_id AS query_id, a.vec_id AS doc_id, (a.label = b.label)::INT AS rel FROM embeddings a, q b WHERE a.vec_id <> b.vec_id AND (a.vec_id + b.vec_id) % 3 <> 0)"


def _judged(results: DataFrame) -> DataFrame:
    """Of the found pairs the judged ones: other judgements bear on no bound."""
    j = results.where((F.col("vec_id") + F.col("query_id")) % 3 != 0)
    return j.select("query_id", F.col("vec_id").alias("doc_id"), (F.col("label") == F.col("query_label")).cast("int").alias("rel"))


_RUNS_OF = """, runs AS (SELECT 'semantic' AS method, query_id, vec_id AS doc_id, rank, label, query_label FROM res
  UNION ALL SELECT 'reranked', query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY vec_id % 7 DESC, similarity DESC, vec_id) AS INTEGER), label, query_label FROM res
  UNION ALL SELECT 'filtered', query_id, vec_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, vec_id) AS INTEGER), label, query_label FROM res WHERE label = query_label),
pool AS (SELECT query_id, doc_id, string_agg(DISTINCT method, ',' ORDER BY method) AS methods, any_value(label = query_label) AS same FROM runs WHERE rank <= 3 GROUP BY 1, 2),
known AS (SELECT query_id, doc_id, same::INT AS rel FROM pool WHERE doc_id % 3 <> 0), asked AS (SELECT query_id, doc_id, same::INT AS rel FROM pool WHERE doc_id % 3 = 0),
rels AS (SELECT * FROM known WHERE rel = 1 UNION SELECT * FROM asked WHERE rel = 1)"""


def _method_runs(s: SparkSession, d: str) -> DataFrame:
    """(method, query_id, doc_id, rank, label, query_label): three rankings of each query's results."""
    same = F.coalesce(F.col("label") == F.col("query_label"), F.lit(False))
    w = Window.partitionBy("query_id")
    found = {
        "semantic": F.col("rank"), "reranked": F.row_number().over(w.orderBy(F.desc(F.col("vec_id") % 7), F.desc("similarity"), "vec_id")),
        "filtered": F.when(same, F.row_number().over(w.orderBy(F.desc(same), F.desc("similarity"), "vec_id"))),
    }
    r = _results(s, d).withColumns({f"by_{m}": rank for m, rank in found.items()})
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("method"), F.col(f"by_{m}").alias("rank")) for m in found]))
    rows = r.select("query_id", F.col("vec_id").alias("doc_id"), "label", "query_label", each.alias("m"))
    return rows.where("m.rank is not null").select("m.method", "query_id", "doc_id", "m.rank", "label", "query_label")


def _judgements(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rankings, known judgements of the pool, and labels of the rest: ids divisible by 3."""
    runs = _method_runs(s, d)
    pool = runs.where("rank <= 3").select("query_id", "doc_id", (F.col("label") == F.col("query_label")).cast("int").alias("rel")).distinct()
    return runs, pool.where("doc_id % 3 <> 0"), pool.where("doc_id % 3 = 0")


@query("pooled_judgments", _EACH + _RUNS_OF + " SELECT query_id, doc_id, methods FROM pool", False)
def pooled_judgments(s, d):
    return E.pooled(_method_runs(s, d), 3).withColumn("methods", text_list("methods"))


@query("new_pairs", _EACH + _RUNS_OF + " SELECT query_id, doc_id, methods FROM pool WHERE doc_id % 3 = 0", False)
def new_pairs(s, d):
    runs, known, _ = _judgements(s, d)
    return E.new_pairs(E.pooled(runs, 3), known).withColumn("methods", text_list("methods"))


@query("blind_pool", _EACH + _RUNS_OF + " SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sha256(query_id || ':' || doc_id), doc_id) AS INTEGER) AS place FROM pool", False)
def blind_pool(s, d):
    return E.blind_order(E.pooled(_method_runs(s, d), 3)).select("query_id", "doc_id", "place")


@query("adjudicated_score", _EACH + _RUNS_OF + """, n AS (SELECT query_id, count(*) AS n FROM rels GROUP BY 1),
h AS (SELECT r.query_id, method, count(rels.doc_id) AS hits FROM runs r LEFT JOIN rels ON rels.query_id = r.query_id AND rels.doc_id = r.doc_id WHERE rank <= 3 GROUP BY 1, 2)
SELECT query_id, method, hits, hits / 3.0::DOUBLE AS precision, coalesce(hits::DOUBLE / n, 0) AS recall, (hits > 0)::INT::DOUBLE AS hit FROM h LEFT JOIN n USING (query_id)""", False)
def adjudicated_score(s, d):
    return E.adjudicated(*_judgements(s, d), 3)


@query("strategy_ablation", _EACH + _RUNS_OF + """, h AS (SELECT method AS strategy, r.query_id, count(rels.doc_id) AS hits FROM runs r LEFT JOIN rels ON rels.query_id = r.query_id AND rels.doc_id = r.doc_id WHERE rank <= 3 GROUP BY 1, 2),
m AS (SELECT strategy, count(*) AS queries, avg(hits / 3.0::DOUBLE) AS precision, avg((hits > 0)::INT)::DOUBLE AS hit FROM h GROUP BY 1)
SELECT strategy, queries, round(precision, 9) AS precision, hit, round(precision - (SELECT precision FROM m WHERE strategy = 'semantic'), 9) AS precision_gain FROM m""", False)
def strategy_ablation(s, d):
    runs = _method_runs(s, d)
    judged = runs.select("query_id", "doc_id", (F.col("label") == F.col("query_label")).cast("int").alias("rel")).distinct()
    out = E.ablation(runs.withColumnRenamed("method", "strategy"), judged, 3, "semantic")
    return out.withColumns({c: F.round(c, 9) for c in ("precision", "precision_gain")})


_METRICS_SQL = ORACLES["retrieval_metrics"]


@query("macro_metrics", f"SELECT count(*) AS queries, " + ", ".join(f"round(avg({c}), 9) AS {c}" for c in ("precision", "recall", "hit", "reciprocal_rank", "ndcg")) + f" FROM ({_METRICS_SQL})", False)
def macro_metrics(s, d):
    return E.macro_average(retrieval_metrics(s, d)).select("queries", *[F.round(c, 9).alias(c) for c in ("precision", "recall", "hit", "reciprocal_rank", "ndcg")])


@query("aspect_summary", f"""SELECT aspect, count(*) AS queries, round(avg(precision), 4) AS precision, round(avg(recall), 4) AS recall, round(avg(hit), 4) AS hit, round(avg(reciprocal_rank), 4) AS reciprocal_rank,
  count(*) FILTER (n_relevant > 0) AS with_relevant, count(*) FILTER (n_relevant = 0) AS without_relevant FROM (SELECT *, query_id // 20 % 3 AS aspect FROM ({_METRICS_SQL}) JOIN
  (SELECT b.vec_id AS query_id, count(a.vec_id) AS n_relevant FROM embeddings b LEFT JOIN embeddings a ON a.label = b.label AND a.vec_id <> b.vec_id GROUP BY 1) USING (query_id)) GROUP BY 1""", False)
def aspect_summary(s, d):
    rows = retrieval_metrics(s, d).join(_relevant_counts(s, d), "query_id").withColumn("aspect", F.expr(f"query_id div {QUERY_STEP} % 3")).drop("ndcg")
    return E.combined_summary(rows, "aspect")


@query("reference_overlap", _EACH + _RUNS_OF + """ SELECT a.query_id, count(b.doc_id) / 3.0::DOUBLE AS overlap FROM (SELECT * FROM runs WHERE method = 'reranked' AND rank <= 3) a
  LEFT JOIN (SELECT * FROM runs WHERE method = 'semantic' AND rank <= 3) b ON a.query_id = b.query_id AND a.doc_id = b.doc_id GROUP BY 1""", False)
def reference_overlap(s, d):
    runs = _method_runs(s, d)
    return E.overlap_at_k(runs.where("method = 'reranked'"), runs.where("method = 'semantic'"), 3)


def _flagged(s: SparkSession, d: str, k: int = 5) -> DataFrame:
    """(query_id, one, five): the precision of the first hit and of the first five of one search, by a flag of each hit; no
    hits are joined to a copy of themselves."""
    hit = F.col("label") == F.col("query_label")
    return _results(s, d, k).groupBy("query_id").agg((F.count_if(hit & (F.col("rank") <= k)) / k).alias("five"), F.count_if(hit & (F.col("rank") <= 1)).cast("double").alias("one"))


def _bootstrap_sql(values: str) -> str:
    """The bootstrap of ``values`` (query_id, score as DECIMAL(18,9)) by the same draws."""
    lanes = range(E.LANES)
    w = ", ".join(" + ".join(f"(('0x' || substr(h, {1 + 8 * k}, 8))::BIGINT >= {x})::INTEGER" for x in E.poisson_limits()) + f" AS w{k}" for k in lanes)
    sums = " UNION ALL ".join(f"SELECT g * {E.LANES} + {k} AS draw, sum(score * w{k}) AS s, sum(w{k}) AS w FROM hw GROUP BY g" for k in lanes)
    return f""", vals AS ({values}), hh AS (SELECT score, g, md5('42:' || g || ':' || query_id) AS h FROM vals, range({10_000 // E.LANES}) r(g)), hw AS (SELECT score, g, {w} FROM hh),
  mm AS (SELECT list_sort(list(CAST(s AS DOUBLE) / w)) AS m FROM ({sums}) WHERE w > 0)
SELECT (SELECT count(*) FROM vals) AS queries, round(CAST((SELECT sum(score) FROM vals) AS DOUBLE) / (SELECT count(*) FROM vals), 4) AS MEAN, round(m[greatest(CAST(floor(len(m) * 0.025) AS INTEGER), 1)], 4) AS low, round(m[greatest(CAST(floor(len(m) * 0.975) AS INTEGER), 1)], 4) AS high FROM mm"""


_FLAGS = _EACH + ", fl AS (SELECT query_id, count(*) FILTER (label = query_label) / 5.0::DOUBLE AS five, CAST(count(*) FILTER (label = query_label AND rank <= 1) AS DOUBLE) AS one FROM res GROUP BY 1)"


@query("paired_difference", _FLAGS + _bootstrap_sql("SELECT query_id, CAST(CAST(five AS DECIMAL(18,9)) - CAST(one AS DECIMAL(18,9)) AS DECIMAL(18,9)) AS score FROM fl").replace("MEAN", "mean_difference"), False)
def paired_difference(s, d):
    return E.paired_interval(_flagged(s, d).withColumnsRenamed({"five": "x", "one": "y"}))


_CASES = """WITH c AS (SELECT event_type AS run, value, event_id % 5 <> 0 AS verification_passed, CASE event_id % 4 WHEN 0 THEN 'validated_fallback' WHEN 1 THEN NULL ELSE 'llm_generated_validated' END AS generation_status,
  event_id % 900 AS input_tokens, CASE WHEN event_id % 3 = 0 THEN event_id % 200 END AS cached_input_tokens, event_id % 70 AS output_tokens FROM events)"""


@query("llm_run_summary", _CASES + """SELECT run, count(*) AS cases, count(*) FILTER (verification_passed) AS verification_passed, count(*) FILTER (generation_status = 'llm_generated_validated') AS llm_generated_validated,
  count(*) FILTER (generation_status = 'validated_fallback') AS validated_fallback, count(*) FILTER (generation_status IS NULL) AS insufficient_evidence, median(value) FILTER (generation_status IS NOT NULL) AS median_generation_seconds,
  CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cached_input_tokens), 0) AS BIGINT) AS cached_input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  round(sum((greatest(input_tokens - coalesce(cached_input_tokens, 0), 0) * 2.0::DOUBLE + coalesce(cached_input_tokens, 0) * 0.5::DOUBLE + output_tokens * 8.0::DOUBLE) / 1000000), 9) AS estimated_cost FROM c GROUP BY 1""", False)
def llm_run_summary(s, d):
    i = F.col("event_id")
    status = F.when(i % 4 == 0, "validated_fallback").when(i % 4 != 1, "llm_generated_validated")
    cases = table(s, d, "events").select(
        F.col("event_type").alias("run"), (i % 5 != 0).alias("verification_passed"), status.alias("generation_status"), F.col("value").alias("generation_seconds"), F.col("value").alias("end_to_end_seconds"),
        (i % 900).alias("input_tokens"), F.when(i % 3 == 0, i % 200).alias("cached_input_tokens"), (i % 70).alias("output_tokens"),
    )
    out = E.llm_run_summary(cases, {"input": 2.0, "cached_input": 0.5, "output": 8.0}, "run")
    return out.drop("mean_generation_seconds", "mean_end_to_end_seconds").withColumn("estimated_cost", F.round("estimated_cost", 9))


@query("qualitative_averages", """SELECT count(*) AS sample_size, round(avg(doc_id % 5 + 1), 9) AS clarity, round(avg(doc_id % 3 + 3), 9) AS fidelity, round(avg((doc_id % 3 + 3 >= 4)::INT), 9) AS acceptable_rate,
  round(avg(CASE WHEN doc_id % 4 <> 0 THEN quality END), 9) AS meaning_preserved FROM labels""", False)
def qualitative_averages(s, d):
    i = F.col("doc_id")
    rows = table(s, d, "labels").select((i % 5 + 1).alias("clarity"), (i % 3 + 3).alias("fidelity"), F.when(i % 4 != 0, F.col("quality")).alias("meaning_preserved"))
    out = E.qualitative_averages(rows, ["clarity", "fidelity"], ["meaning_preserved"], 4)
    return out.select("sample_size", *[F.round(c, 9).alias(c) for c in out.columns[1:]])


@query("precision_bounds", _EACH + _JUDGED + " SELECT res.query_id, sum(coalesce(rel, 0)) / 5.0::DOUBLE AS lower, sum(coalesce(rel, 1)) / 5.0::DOUBLE AS upper, count(rel)::DOUBLE / count(*) AS coverage FROM res LEFT JOIN judged ON judged.query_id = res.query_id AND judged.doc_id = res.vec_id GROUP BY 1", False)
def precision_bounds(s, d):
    r = _results(s, d)
    return E.precision_bounds(_ranked(r), _judged(r), 5)


@query("paired_outcomes", _EACH + _REL + """, p AS (SELECT res.query_id, count(rel.doc_id) FILTER (rank <= 5) / 5.0::DOUBLE AS a, count(rel.doc_id) FILTER (rank <= 1) / 1.0::DOUBLE AS b FROM res LEFT JOIN rel ON rel.query_id = res.query_id AND rel.doc_id = res.vec_id GROUP BY 1)
SELECT count(*) FILTER (a > b) AS wins, count(*) FILTER (a = b) AS ties, count(*) FILTER (a < b) AS losses, round(avg(a - b), 9) AS mean_difference FROM p""", False)
def paired_outcomes(s, d):
    return E.paired_outcomes(_flagged(s, d).withColumnsRenamed({"five": "x", "one": "y"})).withColumn("mean_difference", F.round("mean_difference", 9))


@query("dominant_component", "SELECT order_status AS dominant FROM (SELECT order_status, count(*) AS n FROM d_orders GROUP BY 1) ORDER BY n DESC, order_status LIMIT 1")
def dominant_component(s, d):
    return E.dominant(V.orders(s, d).groupBy("order_status").agg(F.count(F.lit(1)).alias("n")), "order_status", "n")


# --- sampling -----------------------------------------------------------------------------------------------------


@query("stratified_sample", """SELECT review_id, stratum FROM (SELECT review_id, concat_ws('|', coalesce(CAST(review_score AS VARCHAR), 'none'), CASE WHEN has_title AND has_message THEN 'both' WHEN has_title THEN 'title' WHEN has_message THEN 'message' ELSE 'none' END) AS stratum,
  row_number() OVER (PARTITION BY stratum ORDER BY sha256('42:' || review_id), review_id) AS rn FROM e_canonical) ORDER BY rn, stratum LIMIT 100""")
def stratified_sample(s, d):
    r = enrich.canonical_reviews(V.reviews(s, d), V.links(s, d))
    shape = F.when(F.col("has_title") & F.col("has_message"), "both").when(F.col("has_title"), "title").when(F.col("has_message"), "message").otherwise("none")
    r = r.select("review_id", F.concat_ws("|", F.coalesce(F.col("review_score").cast("string"), F.lit("none")), shape).alias("stratum"))
    return sampling.round_robin(r, 100, "stratum", "review_id")


#: Rows of each group in ``balanced_sample``.
_PER = 12


@query("balanced_sample", f"""WITH e AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS stratum_rank FROM documents WHERE doc_id % 2 = 0 QUALIFY stratum_rank <= {_PER}),
t AS (SELECT doc_id, row_number() OVER (ORDER BY sha256('42:' || doc_id), doc_id) AS stratum_rank FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM e) QUALIFY stratum_rank <= {_PER})
SELECT doc_id, stratum, CAST(stratum_rank AS INTEGER) AS stratum_rank, stratum_rank <= 3 AS pilot FROM (SELECT 'even' AS stratum, * FROM e UNION ALL SELECT 'third', * FROM t)""", False)
def balanced_sample(s, d):
    """Twelve documents of each of two groups that overlap, none twice."""
    t = table(s, d, "documents").select("doc_id", F.array(F.when(F.col("doc_id") % 2 == 0, "even"), F.when(F.col("doc_id") % 3 == 0, "third")).alias("groups"))
    return sampling.balanced(t, ["even", "third"], _PER, "groups", "doc_id")


_SAMPLE = """WITH x AS (SELECT vec_id AS id, vec_id % 4 = 0 AS pilot, list_distinct(['l' || (label % 4), 'm' || (vec_id % 3)]) AS said, list_distinct(['l' || (label % 5), 'm' || (vec_id % 3)]) AS meant FROM embeddings)"""


def _theme_sample(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    v = table(s, d, "embeddings")
    of = lambda k: F.array_distinct(F.array(F.concat(F.lit("l"), (F.col("label") % k).cast("string")), F.concat(F.lit("m"), (F.col("vec_id") % 3).cast("string"))))
    return v.select(F.col("vec_id").alias("id"), (F.col("vec_id") % 4 == 0).alias("pilot"), of(4).alias("themes")), v.select(F.col("vec_id").alias("id"), of(5).alias("themes"))


@query("theme_sample_score", _SAMPLE + """, w AS (SELECT 'final' AS part, * FROM x UNION ALL SELECT 'pilot', * FROM x WHERE pilot), s AS (SELECT part, id, unnest(said) AS label FROM w), t AS (SELECT part, id, unnest(meant) AS label FROM w),
c AS (SELECT part, label, count(*) FILTER (s.id IS NOT NULL AND t.id IS NOT NULL) AS tp, count(*) FILTER (t.id IS NULL) AS fp, count(*) FILTER (s.id IS NULL) AS fn, count(t.id) AS support FROM s FULL JOIN t USING (part, id, label) GROUP BY 1, 2),
a AS (SELECT * FROM c UNION ALL SELECT part, 'micro', CAST(sum(tp) AS BIGINT), CAST(sum(fp) AS BIGINT), CAST(sum(fn) AS BIGINT), CAST(sum(support) AS BIGINT) FROM c GROUP BY 1),
m AS (SELECT part, label, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0) AS recall, support FROM a),
f AS (SELECT part, label, precision, recall, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1, support FROM m)
SELECT * FROM f UNION ALL SELECT part, 'macro', avg(precision), avg(recall), avg(f1), CAST(sum(support) AS BIGINT) FROM f WHERE label <> 'micro' GROUP BY 1""", False)
def theme_sample_score(s, d):
    return E.theme_sample_score(*_theme_sample(s, d))


@query("theme_errors", _SAMPLE + """ SELECT id, list_aggregate(list_sort(list_filter(said, lambda y: NOT list_contains(meant, y))), 'string_agg', ',') AS false_positive,
  list_aggregate(list_sort(list_filter(meant, lambda y: NOT list_contains(said, y))), 'string_agg', ',') AS false_negative FROM x WHERE list_sort(said) <> list_sort(meant)""", False)
def theme_errors(s, d):
    out = E.theme_errors(*_theme_sample(s, d))
    return out.select("id", *[F.when(F.size(c) > 0, text_list(c)).alias(c) for c in ("false_positive", "false_negative")])


@query("hash_sample", "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 50", False)
def hash_sample(s, d):
    return sampling.hash_sample(table(s, d, "documents").select("doc_id"), 50, "doc_id")


# --- scaling ------------------------------------------------------------------------------------------------------


@query("scaled_orders", "SELECT o_orderkey || '__copy_' || r AS order_id, o_custkey || '__copy_' || r AS customer_id, r AS replica FROM orders, range(3) t(r)", False)
def scaled_orders(s, d):
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    return scaling.replicate(o, 3, ["order_id", "customer_id"])


@query("scaled_checks", """WITH o AS (SELECT * FROM orders UNION ALL SELECT * FROM orders WHERE o_orderkey % 10 = 0)
SELECT (SELECT count(*) FROM o WHERE o_orderkey % 7 = 0) * 3 AS null_keys, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0 AND o_orderkey % 7 <> 0) * 3 AS duplicate_keys, (SELECT count(*) FROM o) * 3 AS orders,
  (SELECT count(DISTINCT o_custkey) FROM o WHERE o_custkey % 13 = 0 AND o_custkey IN (SELECT c_custkey FROM customer)) * 3 AS orphans""", False)
def scaled_checks(s, d):
    """Checks on replicas of orders with planted faults: some keys twice, some missing, some customers lost."""
    o = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"))
    o = o.unionByName(o.where("order_id % 10 = 0")).withColumn("order_id", F.when(F.col("order_id") % 7 != 0, F.col("order_id")))
    c = table(s, d, "customer").where("c_custkey % 13 <> 0").select(F.col("c_custkey").alias("customer_id"))
    o, c = scaling.replicate(o, 3, ["order_id", "customer_id"]), scaling.replicate(c, 3, ["customer_id"])
    n = o.agg(F.count(F.lit(1)).alias("orders"))
    lost = quality.orphans(o, "customer_id", c, "customer_id").agg(F.count(F.lit(1)).alias("orphans"))
    return quality.key_violations(o, ["order_id"]).crossJoin(F.broadcast(n)).crossJoin(F.broadcast(lost))  # one row each


_RELATIONS = """WITH o AS (SELECT o_orderkey AS order_id FROM orders UNION ALL SELECT o_orderkey FROM orders WHERE o_orderkey % 50 = 0), r AS (SELECT doc_id AS review_id FROM documents WHERE doc_id % 20 <> 7),
l AS (SELECT doc_id AS review_id, doc_id AS order_id FROM documents UNION ALL SELECT doc_id, doc_id FROM documents WHERE doc_id % 30 = 0), t AS (SELECT DISTINCT doc_id AS review_id, 'x' AS theme FROM documents WHERE doc_id % 2 = 1)"""


@query("relationship_checks", _RELATIONS + """ SELECT 'duplicate orders_enriched' AS "check", (SELECT count(*) FROM orders WHERE o_orderkey % 50 = 0) * 2 AS violations UNION ALL SELECT 'duplicate reviews_enriched', 0
UNION ALL SELECT 'duplicate review_order_links', (SELECT count(*) FROM documents WHERE doc_id % 30 = 0) * 2 UNION ALL SELECT 'duplicate review_themes', 0
UNION ALL SELECT 'orphan review_order_links order_id', (SELECT count(DISTINCT order_id) FROM l WHERE order_id NOT IN (SELECT order_id FROM o)) * 2
UNION ALL SELECT 'orphan review_order_links review_id', (SELECT count(DISTINCT review_id) FROM l WHERE review_id NOT IN (SELECT review_id FROM r)) * 2
UNION ALL SELECT 'orphan review_themes review_id', (SELECT count(DISTINCT review_id) FROM t WHERE review_id NOT IN (SELECT review_id FROM r)) * 2""", False)
def relationship_checks(s, d):
    """Checks on tables at factor 2 with planted faults: some orders and links twice, some reviews lost."""
    return scaling.relationship_checks({k: scaling.scaled(v, k, 2) for k, v in _curated(s, d).items()})


def _curated(s: SparkSession, d: str) -> dict[str, DataFrame]:
    o, docs = table(s, d, "orders").select(F.col("o_orderkey").alias("order_id")), table(s, d, "documents").select(F.col("doc_id").alias("review_id"))
    links = docs.withColumn("order_id", F.col("review_id"))
    return {
        "orders_enriched": o.unionByName(o.where("order_id % 50 = 0")), "reviews_enriched": docs.where("review_id % 20 <> 7"),
        "review_order_links": links.unionByName(links.where("review_id % 30 = 0")), "review_themes": docs.where("review_id % 2 = 1").withColumn("theme", F.lit("x")),
    }


@query("logical_input_rows", _RELATIONS + """, n AS (SELECT (SELECT count(*) FROM o) AS o, (SELECT count(*) FROM r) AS r, (SELECT count(*) FROM l) AS l, (SELECT count(*) FROM t) AS t)
SELECT 'A' AS workload, o AS "rows" FROM n UNION ALL SELECT 'B', o + r + l FROM n UNION ALL SELECT 'C', o + r + l + t FROM n""", False)
def logical_input_rows(s, d):
    counts = [v.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(k).alias("dataset"), "row_count") for k, v in _curated(s, d).items()]
    return scaling.logical_rows(reduce(DataFrame.unionByName, counts))


@query("workload_a", """SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS orders, CAST(CAST(sum(v) AS DECIMAL(18,2)) AS DOUBLE) AS "value", CAST(sum(late) AS BIGINT) AS late FROM
  (SELECT count(*) AS n, CAST(sum(order_value) AS DECIMAL(18,2)) AS v, count(*) FILTER (is_late) AS late FROM e_orders GROUP BY purchase_year, purchase_month, order_category)""")
def workload_a(s, d):
    return scaling.workload_a(facts(s, d))


@query("workload_b", "SELECT count(*) AS groups, CAST(sum(n) AS BIGINT) AS links, CAST(sum(sc) AS BIGINT) AS scores FROM (SELECT count(*) AS n, sum(review_score) AS sc FROM d_links JOIN e_orders USING (order_id) JOIN d_reviews USING (review_id) GROUP BY customer_state, order_status)")
def workload_b(s, d):
    return scaling.workload_b(facts(s, d), V.links(s, d), V.reviews(s, d))


@query("workload_c", """SELECT count(*) AS groups, CAST(sum(r) AS BIGINT) AS reviews, CAST(sum(o) AS BIGINT) AS orders, CAST(sum(s) AS BIGINT) AS signals FROM (
  SELECT count(DISTINCT l.review_id) AS r, count(DISTINCT l.order_id) AS o, count(*) FILTER (v.review_score <= 2 AND text_is_eligible) AS s FROM d_links l JOIN e_orders o ON o.order_id = l.order_id JOIN e_reviews v ON v.review_id = l.review_id
  LEFT JOIN e_themes t ON t.review_id = l.review_id GROUP BY o.purchase_year, o.customer_state, order_category, CASE WHEN is_late THEN 'late' WHEN is_late IS NULL THEN 'unknown' ELSE 'on_time' END, theme)""")
def workload_c(s, d):
    return scaling.workload_c(facts(s, d), V.links(s, d), themes.annotated(enrich.canonical_texts(V.reviews(s, d)), rules=R.RULES_SYNTHETIC))


def _records(s: SparkSession, d: str) -> DataFrame:
    """Run records by workload and factor: the events, their value as milliseconds."""
    factor = F.element_at(F.array(*[F.lit(x) for x in (1, 2, 5, 10)]), (F.col("user_id") % 4 + 1).cast("int"))
    return table(s, d, "events").select(F.col("event_type").alias("workload"), factor.alias("factor"), ((F.floor(F.abs("value") * 1000) + 1) / 1000).alias("seconds"), (F.col("event_id") % 1000 + 1).alias("rows"), F.col("event_id").alias("run"))


_RECORDS = """WITH runs AS (SELECT event_type AS workload, [1, 2, 5, 10][user_id % 4 + 1] AS factor, (floor(abs("value") * 1000) + 1) / 1000 AS seconds, event_id % 1000 + 1 AS n, event_id AS run FROM events)"""


@query("run_summary", _RECORDS + """ SELECT workload, factor, round(mean_seconds, 6) AS mean_seconds, round(stddev_seconds, 6) AS stddev_seconds, round(throughput, 6) AS throughput, round(mean_seconds / first_value(mean_seconds) OVER w, 6) AS time_growth,
  factor::DOUBLE / first_value(factor) OVER w AS factor_growth FROM (SELECT workload, factor, avg(seconds) AS mean_seconds, stddev_samp(seconds) AS stddev_seconds, avg(n / seconds) AS throughput FROM runs GROUP BY 1, 2) WINDOW w AS (PARTITION BY workload ORDER BY factor)""", False)
def run_summary(s, d):
    out = scaling.run_summary(_records(s, d))
    return out.withColumns({c: F.round(c, 6) for c in ("mean_seconds", "stddev_seconds", "throughput", "time_growth")})


@query("cloud_speedup", _RECORDS + """ SELECT factor, workload, a / b AS speedup FROM (SELECT workload, factor, min(seconds) FILTER (run % 2 = 0) AS a, min(seconds) FILTER (run % 2 = 1 AND factor <> 5) AS b FROM runs GROUP BY 1, 2) WHERE a IS NOT NULL AND b IS NOT NULL""", False)
def cloud_speedup(s, d):
    """Even runs are the local ones, odd ones the cloud's, which lack a factor."""
    best = lambda rows: rows.groupBy("workload", "factor").agg(F.min("seconds").alias("seconds"))
    runs = _records(s, d)
    return scaling.speedup(best(runs.where("run % 2 = 0")), best(runs.where("run % 2 = 1 and factor <> 5")))


@query("result_linearity", """SELECT 'A' AS workload, true AS is_linear, true AS is_repeatable UNION ALL SELECT 'lossy', lost = 0, true FROM (SELECT count(*) AS lost FROM orders WHERE o_orderkey % 5 = 0)
  UNION ALL SELECT 'unstable', lost = 0, lost = 0 FROM (SELECT count(*) AS lost FROM orders WHERE o_orderkey % 5 = 0)""", False)
def result_linearity(s, d):
    """Workload A over real replicas at factors 1, 2 and 1 again; ``lossy`` loses every fifth order at factor 2, ``unstable``
    in the repeated run."""
    o = table(s, d, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.year("o_orderdate").alias("purchase_year"), F.month("o_orderdate").alias("purchase_month"), F.col("o_orderpriority").alias("order_category"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("order_value"), (F.col("o_orderstatus") == "F").alias("is_late"),
    )
    runs = []
    for name, bad in (("A", None), ("lossy", 1), ("unstable", 2)):
        for k, factor in enumerate((1, 2, 1)):
            some = o.where("order_id % 5 <> 0") if k == bad else o
            one = scaling.workload_a(scaling.replicate(some, factor, ["order_id"]))
            runs.append(one.select(F.lit(name).alias("workload"), F.lit(factor).alias("factor"), F.col("orders").cast("double").alias("measure"), F.sha2(F.to_json(F.struct(*one.columns)), 256).alias("checksum")))
    return scaling.linearity(reduce(DataFrame.unionByName, runs))


def _environments(s: SparkSession, d: str) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    """Datasets of the given tables, and the same elsewhere: dealt anew, some rows lost, some values and one type changed."""
    one = {"customers": table(s, d, "customer"), "links": V.links(s, d), "orders": table(s, d, "orders"), "reviews": V.reviews(s, d).select("review_id", "review_score", "lang"), "events": table(s, d, "events"), "parts": table(s, d, "part")}
    price = F.when(F.col("o_orderkey") % 1000 == 7, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice"))
    two = {
        "customers": one["customers"].repartition(5, "c_acctbal"), "links": one["links"].where("review_id % 10 <> 3"), "orders": one["orders"].withColumn("o_totalprice", price),
        "reviews": one["reviews"].withColumn("review_score", F.col("review_score").cast("long")), "parts": one["parts"],
    }
    return one, two


_CONTRACTS = {"parts": manifests.Contract({"p_partkey": "bigint", "p_size": "int"}, ("p_partkey", "p_name"), {"size": "p_size <= 49"}), "customers": manifests.Contract({"c_custkey": "bigint"}, ("c_custkey", "c_name"))}


@query("manifest_comparison", """, n AS (SELECT (SELECT count(*) FROM customer) AS c, (SELECT count(*) FROM d_links) AS l, (SELECT count(*) FROM d_links WHERE review_id % 10 <> 3) AS kept, (SELECT count(*) FROM orders) AS o,
  (SELECT count(*) FROM orders WHERE o_orderkey % 1000 = 7) AS moved, (SELECT count(*) FROM d_reviews) AS r, (SELECT count(*) FROM events) AS e, (SELECT count(*) FROM part) AS p, (SELECT count(*) FROM part WHERE p_size > 49 OR p_name IS NULL) AS broken)
SELECT 'customers' AS dataset, 'compatible' AS verdict, c AS first_rows, c AS second_rows FROM n UNION ALL SELECT 'links', CASE WHEN kept < l THEN 'count' ELSE 'compatible' END, l, kept FROM n
  UNION ALL SELECT 'orders', CASE WHEN moved > 0 THEN 'content' ELSE 'compatible' END, o, o FROM n UNION ALL SELECT 'reviews', 'schema', r, r FROM n UNION ALL SELECT 'events', 'missing', e, NULL FROM n
  UNION ALL SELECT 'parts', CASE WHEN broken > 0 THEN 'contract' ELSE 'compatible' END, p, p FROM n""")
def manifest_comparison(s, d):
    one, two = (manifests.manifest(frames, _CONTRACTS) for frames in _environments(s, d))
    return manifests.compare(one, two).select("dataset", "verdict", "first_rows", "second_rows")


@query("bootstrap_ci", _FLAGS + _bootstrap_sql("SELECT query_id, CAST(five AS DECIMAL(18,9)) AS score FROM fl").replace("MEAN", "mean"), False)
def bootstrap_ci(s, d):
    return E.bootstrap(_flagged(s, d).select("query_id", F.col("five").alias("score")))
