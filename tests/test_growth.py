"""What tasks hold, and how often inputs are read, as tables grow."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from marketlens.operators import enrich, index, ivf, themes
from marketlens.plans import catalog
from marketlens.sources import domain as V
from marketlens.sources.bucketed import BucketTable

FOLDER = "/root/testdata/sf0.001"


def test_probes_come_in_bounded_batches():
    """A query's vector goes with each of its cells: 500 queries by 301 cells are 150,500 rows, never one batch."""
    rng = np.random.default_rng(1)
    centroids = ivf._units(pa.array(list(rng.normal(size=(300, 8)))))
    queries = pa.RecordBatch.from_arrays([pa.array(range(500)), pa.array(list(rng.normal(size=(500, 8))))], names=["query_id", "query"])
    got = list(ivf.probes_of(iter([queries]), centroids, np.full(300, 0.5), 0, 301, True))
    assert max(b.num_rows for b in got) <= ivf.BATCH
    rows = pa.Table.from_batches(got)
    pairs = set(zip(rows["query_id"].to_pylist(), rows["cell"].to_pylist(), strict=True))
    assert rows.num_rows == len(pairs) == 500 * 301
    assert rows["query"].slice(301 * 7, 1)[0].as_py() == queries["query"][7].as_py()


def test_texts_are_normalised_once(spark):
    """The plan of a table's themes has one pattern for what is no letter, and each rule once."""
    rows = spark.createDataFrame([("Ainda não recebi",), (None,), ("Produto excelente",), ("ru",)], "t string")
    made = themes.with_theme_array(rows, F.col("t"))
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1 and plan.count("nunca chegou") == 1
    assert [r["themes"] for r in made.collect()] == [r[0] for r in rows.select(themes.theme_array(F.col("t"))).collect()]
    plan = catalog.QUERIES["themes_rules_v3"](spark, FOLDER)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_only_orders_near_reviews_are_read(spark):
    """Scans of orders and lines end where the linked ids do; tables without reviews need no order."""
    span = enrich.order_span(V.links(spark, FOLDER))
    ids = [r[0] for r in V.links(spark, FOLDER).select("order_id").collect()]
    assert span == (min(ids), max(ids))
    got = {r[0] for r in catalog.facts(spark, FOLDER, span).select("order_id").collect()}
    assert set(ids) <= got and (min(got), max(got)) == span
    plan = _plan(catalog.QUERIES["document_metadata"](spark, FOLDER))
    assert "LessThanOrEqual(l_orderkey" in plan and "LessThanOrEqual(o_orderkey" in plan
    none = V.links(spark, FOLDER).limit(0)
    assert enrich.order_span(none) == (None, None) and catalog.facts(spark, FOLDER, (None, None)).count() == 0


def test_both_sides_of_an_index_read_what_is_written(spark):
    """The documents are made once, not for each side and each part of the result."""
    for name in ("index_applied", "index_sync_actions", "index_sync_summary"):
        assert "lineitem" not in _plan(catalog.QUERIES[name](spark, FOLDER))


def test_a_synchronisation_reads_its_documents_twice(spark, tmp_path):
    """Once for their hashes and once for what is stored; the check for repeated ids reads the hashes."""
    read = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            read.add(len(f))
            yield f

    kind = "document_id string, document_hash string, metadata_hash string"
    wanted = spark.createDataFrame([(f"d{i}", f"h{i}", "m") for i in range(40)], kind).mapInPandas(counted, kind)
    at = BucketTable(spark, str(tmp_path / "index"), "document_id", 4)
    _, counters = index.synchronise_buckets(wanted, at, lambda rows: rows.withColumn("embedding", F.array(F.lit(0.5))), "m", "1")
    assert counters["documents_upserted"] == 40 and at.read().count() == 40
    assert read.value == 80
