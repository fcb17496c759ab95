"""The inverted-file search, the KPI cube, the bootstrap, manifests, guards and plan sizes, against plain Python or a plainer
operator."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from marketlens.operators import cube, ivf, kpi, manifests, quality, retrieval
from marketlens.operators import evaluation as E
from marketlens.plans import catalog
from marketlens.session import table

FOLDER = "/root/testdata/sf0.001"


def clustered(n=3000, width=16, seed=1):
    draw = np.random.default_rng(seed)
    centres = draw.normal(size=(30, width))
    x = centres[draw.integers(0, 30, n)] + 0.35 * draw.normal(size=(n, width))
    rows = [(k, [float(v) for v in x[k]], int(k % 7)) for k in range(n)]
    rows += [(n, None, 1), (n + 1, [0.0] * width, 1)] + [(n + 2 + k, rows[0][1], 2) for k in range(400)]  # no direction; a crowd of copies
    return rows


@pytest.fixture(scope="module")
def vectors(spark):
    return spark.createDataFrame(clustered(), "vec_id long, embedding array<double>, label int").repartition(4).cache()


@pytest.fixture(scope="module")
def asked(vectors):
    return vectors.where("vec_id % 20 = 0").select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_label"), F.col("embedding").alias("query"))


def ranked(rows):
    out = {}
    for r in rows.collect():
        out.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["similarity"])
    return out


def test_inverted_file_recall(spark, vectors, asked, monkeypatch):
    """The nearest cells find at least nine tenths of what the exact scan finds; the exact mode finds all, in order."""
    exact = ranked(retrieval.top_k_each(vectors, asked, 10))
    index = ivf.build(vectors, recall=0.95, k=10)
    assert index.probes < len(index.centroids) / 2 and index.rows.count() == vectors.count()
    near = ranked(ivf.search(index, asked, 10))
    # copies at one similarity stand for each other
    worst = {q: min((s for _, s in found.values() if s is not None), default=None) for q, found in exact.items()}
    hits = sum(s >= worst[q] - 1e-9 for q, found in near.items() for _, s in found.values() if s is not None and worst[q] is not None)
    total = sum(len(found) for q, found in exact.items() if worst[q] is not None)
    assert hits / total >= 0.9
    assert ranked(ivf.search(index, asked, 10, exact=True)) == exact
    monkeypatch.setattr(ivf, "ROWS", 50)  # the crowd's cell in many blocks
    monkeypatch.setattr(ivf, "QUERIES", 40)
    small = ivf.build(vectors, cells=12)
    assert max(small.blocks.values()) > 5
    assert ranked(ivf.search(small, asked, 10, exact=True)) == exact


def test_inverted_file_widens_under_a_filter(spark, vectors, asked):
    """A filter that leaves few rows in a cell widens the search until there are k hits, or no cell is left."""
    index = ivf.build(vectors, cells=40)
    rare = F.col("vec_id") % 401 == 3
    got = ranked(ivf.search(index, asked, 5, rare))
    assert all(len(found) == 5 for found in got.values()) and len(got) == asked.count()
    assert ranked(ivf.search(index, asked, 5, rare, exact=True)) == ranked(retrieval.top_k_each(vectors.where(rare), asked, 5))
    assert {len(x) for x in ranked(ivf.search(index, asked, 5, F.col("vec_id") == 3)).values()} == {1}
    assert ivf.search(index, asked.limit(0), 5).count() == 0
    assert ivf.search(ivf.build(vectors.limit(0)), asked, 5).count() == 0


def random_filters(n, r):
    months = [f"{y}-{m:02d}" for y in (2017, 2018) for m in range(1, 13)]
    out = []
    for k in range(n):
        start = r.choice([None, *months])
        end = r.choice([None, max(start, r.choice(months))]) if start else None
        out.append((k, r.choice([None, "books", "toys", "none"]), r.choice([None, "sp", "RJ", "XX", ""]), start, end))
    return out


def test_cube_equals_single_reports(spark):
    r = random.Random(4)
    date = lambda: f"{r.choice([2017, 2018])}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}"
    orders = [(f"o{k}", r.choice(["books", "toys", None]), r.choice(["SP", "RJ", None]), date() if k % 17 else None, r.choice(["delivered", "canceled", None]), r.choice([None, f"{r.randint(1, 999)}.5"]), r.choice([True, False, None]), r.random() * 9 - 4) for k in range(400)]
    reviews = [(f"r{k}", r.choice(["books", "toys", None]), r.choice(["SP", "rj", None]), r.choice([2017, 2018, None]), r.randint(1, 12), r.choice([1, 2, 3, 4, 5, None])) for k in range(400)]
    o = spark.createDataFrame(orders, "order_id string, order_category string, customer_state string, purchase_date string, order_status string, order_value string, is_late boolean, delivery_delay_days double")
    o = o.withColumns({"purchase_date": F.col("purchase_date").cast("date"), "order_value": F.col("order_value").cast("decimal(12,2)"), "delivery_delay_days": F.round("delivery_delay_days", 3)})
    v = spark.createDataFrame(reviews, "review_id string, product_category string, customer_state string, purchase_year int, purchase_month int, review_score int")
    made = cube.build(o, v)
    filters = random_filters(100, r)
    table_ = spark.createDataFrame(filters, "filter_id int, category string, state string, start_month string, end_month string")
    plain = lambda row: tuple(None if x is None else round(x, 9) if isinstance(x, float) else x for x in row)
    got = {}
    for row in cube.answers(made, table_).collect():
        got.setdefault(row["filter_id"], set()).add(plain(row[1:]))
    assert len(got) == 100
    shares = {(x["filter_id"], x["status"]): (x["current_count"], x["current_share"], x["baseline_share"]) for x in cube.statuses(made, table_).collect()}
    for k in r.sample(range(100), 12):
        f = kpi.Filters(*filters[k][1:])
        assert got[k] == {plain(x) for x in kpi.analyze(o, v, f).collect()}, filters[k]
        single = {(k, x["status"]): (x["current_count"], x["current_share"], x["baseline_share"]) for x in kpi.status_comparison(o, f).collect()}
        assert {key: x for key, x in shares.items() if key[0] == k} == single
    half = cube.merged(cube.build(o.where("hash(order_id) % 2 = 0"), v.where("hash(review_id) % 2 = 0")), cube.build(o.where("hash(order_id) % 2 <> 0"), v.where("hash(review_id) % 2 <> 0")))
    assert sorted(map(repr, half.orders.collect())) == sorted(map(repr, made.orders.collect())) and sorted(map(repr, half.reviews.collect())) == sorted(map(repr, made.reviews.collect()))
    with pytest.raises(Exception, match="not a period: filter 7"):
        cube.answers(made, spark.createDataFrame([(7, None, None, "2018-13", None)], table_.schema)).collect()


def test_bootstrap_covers_the_mean(spark):
    """Intervals of known samples are about as wide as the normal approximation, by group, whatever the partitioning."""
    draw = np.random.default_rng(3)
    rows = [(g, f"q{k}", float(x)) for g, n in (("a", 400), ("b", 40)) for k, x in enumerate(draw.normal(5, 2, n).round(3))] + [("c", "q", None)]
    scores = spark.createDataFrame(rows, "variant string, query_id string, score double")
    got = {r["variant"]: r for r in E.bootstrap(scores, "variant", draws=2000).collect()}
    for g in "ab":
        x = np.array([r[2] for r in rows if r[0] == g])
        half = 1.96 * x.std() / len(x) ** 0.5
        assert abs(got[g]["mean"] - x.mean()) < 1e-3 and abs((got[g]["high"] - got[g]["low"]) / 2 / half - 1) < 0.15
    assert tuple(got["c"]) == ("c", 0, 0.0, 0.0, 0.0)
    assert sorted(map(tuple, E.bootstrap(scores.repartition(7), "variant", draws=2000).collect())) == sorted(map(tuple, got.values()))


def test_manifests(spark):
    rows = spark.createDataFrame([(1, None, "x", {"b": 1, "a": 2}), (2, "y", None, {}), (2, "y", None, {})], "k int, a string, b string, m map<string,int>")
    one = lambda df: tuple(manifests.content(df).first())
    assert one(rows) == one(rows.repartition(3).select("m", "b", "a", "k")) and one(rows)[0] == 3
    assert one(rows) != one(rows.select("k", F.col("b").alias("a"), F.col("a").alias("b"), "m"))  # nulls count where they are
    assert one(rows) != one(rows.limit(2)) and one(rows.limit(0)) == (0, 0, 0)
    parts = manifests.content(rows, "k").collect()
    assert sum(p["row_count"] for p in parts) == 3
    contract = manifests.Contract({"k": "int", "z": "int"}, ("a",), {"small": "k < 2"})
    found = manifests.manifest({"t": rows}, {"t": contract}).first()
    assert (found["broken_types"], found["violations"]) == ("z", 3)
    kept = manifests.compare(manifests.manifest({"t": rows, "u": rows}), manifests.manifest({"t": rows.orderBy("k")})).collect()
    assert {r["dataset"]: r["verdict"] for r in kept} == {"t": "compatible", "u": "missing"}


def test_guard_counts_in_the_job_that_writes(spark, tmp_path):
    left = spark.createDataFrame([(1,), (2,), (None,)], "k int")
    right = spark.createDataFrame([(1, "a"), (3, "b")], "k int, v string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("guard", "guard")
    assert quality.write_guarded(left, right, "k", f"{tmp_path}/ok", "l to r") == {"check": "l to r", "rows_before": 3, "rows_after": 3, "null_keys": 1, "passed": True}
    jobs = len(tracker.getJobIdsForGroup("guard"))
    spark.sparkContext.setJobGroup("plain", "plain")
    left.join(right, "k", "left").write.parquet(f"{tmp_path}/plain")
    assert jobs == len(tracker.getJobIdsForGroup("plain"))
    spark.sparkContext.setJobGroup("rest", "rest")
    with pytest.raises(ValueError, match="Fan-out detected: l to r: 3 rows became 4"):
        quality.write_guarded(left, right.unionByName(right), "k", f"{tmp_path}/bad", "l to r")
    assert not (tmp_path / "bad").exists()


@pytest.mark.parametrize("name, scans, exchanges", [("kpi_period_vs_baseline", 8, 10), ("theme_evidence", 8, 10), ("rag_documents", 8, 10), ("workload_c", 8, 10), ("monthly_reviews_trailing", 8, 10)])
def test_plans_stay_small(spark, name, scans, exchanges):
    plan = catalog.QUERIES[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= scans and len(re.findall(r"\bExchange (?:hash|range|Single|Round)", plan)) <= exchanges
    tables = re.findall(r"FileScan parquet.*?Location: \w+\(\d+ paths?\)\[file:[^\]]*?/([\w-]+?)\.parquet", plan)
    assert all(tables.count(t) <= 2 for t in tables)


def test_order_facts_equal_enriched_orders(spark):
    columns = ["order_id", "order_status", "order_category", "customer_state", "order_value", "is_late", "delivery_delay_days", "purchase_date"]
    whole, lean = (f(spark, FOLDER).select(*columns) for f in (catalog.enriched_orders, catalog.facts))
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, lean.collect())) and table(spark, FOLDER, "orders").count() == lean.count()
