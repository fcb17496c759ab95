from math import isclose

import pytest
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.operators import answers, documents, eda, kpi, quality, scaling, themes
from marketlens.operators import evaluation as E

ORDERS = "order_id string, order_category string, customer_state string, purchase_date date, order_status string, order_value decimal(18,2), is_late boolean, delivery_delay_days double"


def one(df):
    return {r["metric"]: r for r in df.collect()}


def test_kpi_against_three_months_before(spark):
    from datetime import date
    from decimal import Decimal

    rows = [(f"b{m}", "books", "SP", date(2017 if m == 12 else 2018, m, 5), "delivered", Decimal(100), False, -1.0) for m in (12, 1, 2)]
    rows += [("c1", "books", "SP", date(2018, 3, 1), "delivered", Decimal(200), True, 4.0), ("c2", "books", "SP", date(2018, 3, 31), "canceled", Decimal(300), None, None), ("x", "toys", "RJ", date(2018, 3, 2), "delivered", Decimal(9), False, 0.0)]
    reviews = [(f"r{m}", "books", "SP", 2017 if m == 12 else 2018, m, 4) for m in (12, 1, 2)] + [("r3", "books", "SP", 2018, 3, 1), ("r4", "books", "SP", 2018, 3, 2), ("r5", "toys", "RJ", 2018, 3, 5)]
    o = spark.createDataFrame(rows, ORDERS)
    r = spark.createDataFrame(reviews, "review_id string, product_category string, customer_state string, purchase_year int, purchase_month int, review_score int")
    got = one(kpi.analyze(o, r, kpi.Filters("books", "sp", "2018-03")))
    assert (got["average_rating"]["value"], got["average_rating"]["baseline"], got["average_rating"]["change"]) == (1.5, 4.0, -2.5)
    assert got["negative_rate"]["value"] == 1.0 and got["score_1_share"]["value"] == 0.5
    assert got["late_rate"]["value"] == 1.0 and got["late_rate"]["denominator"] == 1
    assert got["average_delay_days"]["value"] == 4.0 and got["order_volume"]["value"] == 2 and got["average_order_value"]["value"] == 250.0
    none = one(kpi.analyze(o, r, kpi.Filters(state="XX", start_month="2018-03")))
    assert none["order_volume"]["value"] == 0 and none["negative_rate"]["value"] is None
    assert one(kpi.analyze(o, r, kpi.Filters()))["average_rating"]["baseline"] is None
    shares = {x["status"]: x["current_share"] for x in kpi.status_comparison(o, kpi.Filters("books", "SP", "2018-03")).collect()}
    assert shares["canceled"] == 0.5


def test_filters():
    assert kpi.baseline(kpi.Filters(start_month="2018-03")) == kpi.Filters(start_month="2017-12", end_month="2018-02")
    assert kpi.baseline(kpi.Filters()) is None
    for bad in (kpi.Filters(start_month="2018-13"), kpi.Filters(end_month="2018-01"), kpi.Filters(start_month="2018-03", end_month="2018-02")):
        with pytest.raises(ValueError):
            bad.validated()


def test_trailing_rows(spark):
    rows = [(2018, m, 6 - m, True) for m in (1, 2, 3, 4) for _ in range(2)]
    df = spark.createDataFrame(rows, "purchase_year int, purchase_month int, review_score int, text_is_eligible boolean")
    april = eda.monthly_reviews(df, 2).where("month = date'2018-04-01'").first()
    assert (april["baseline_months"], april["baseline_rating"], april["average_rating"], april["rating_variation"], april["negative_rate"]) == (3, 4.0, 2.0, -2.0, 1.0)


@pytest.mark.parametrize(
    ("version", "text", "expected"),
    [
        ("rules-pt-v2", "Ainda não recebi e quero reembolso", {"non_delivery", "service_or_refund"}), ("rules-pt-v2", "Produto quebrado e com defeito", {"damaged_or_defective"}),
        ("rules-pt-v2", "ru", {"uncertain"}), ("rules-pt-v2", "Embalagem sem manual adequado e instruções confusas", {"other"}), ("any", "Produto excelente e entrega perfeita", {"other"}),
        ("rules-pt-v3", "Recebi o produto no prazo mas veio com defeito", {"damaged_or_defective"}), ("rules-pt-v3", "O prazo já passou e ainda não recebi", {"delivery_delay", "non_delivery"}),
        ("rules-pt-v3", "Produto de qualidade, recomendo", {"other"}), ("rules-pt-v3", "Fiz um pedido e recebi outro totalmente diferente", {"wrong_or_missing_item"}),
        ("rules-pt-v3", "Pedi reembolso e até agora não recebi o dinheiro", {"service_or_refund"}), ("rules-pt-v3", "O produto chegou quebrado e já postei devolvendo", {"damaged_or_defective", "service_or_refund"}),
    ],
)
def test_theme_rules(spark, version, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(themes.theme_array(F.col("t"), version)).first()[0]
    assert set(got) == expected


def test_meaningful_text(spark):
    rows = [(".", False), ("4", False), ("ru", True), ("Produto ruim", True), (None, False), ("😀", False)]
    got = spark.createDataFrame(rows, "t string, e boolean").select(S.is_meaningful(F.col("t")), "e").collect()
    assert all(a == b for a, b in got)


def test_sync_actions(spark):
    cols = "document_id string, document_hash string, metadata_hash string"
    new = spark.createDataFrame([("a", "1", "1"), ("b", "2", "1"), ("c", "1", "2"), ("d", "1", "1")], cols)
    old = spark.createDataFrame([("a", "1", "1"), ("b", "1", "1"), ("c", "1", "1"), ("e", "1", "1")], cols)
    got = {r[0]: r[1] for r in documents.sync_actions(new, old).collect()}
    assert got == {"a": "skip", "b": "upsert", "c": "update_metadata", "d": "upsert", "e": "delete"}


def test_guards(spark):
    left = spark.createDataFrame([("1",), ("2",)], "k string")
    twice = spark.createDataFrame([("1", "a"), ("1", "b")], "k string, v string")
    with pytest.raises(ValueError, match="Fan-out"):
        quality.join_without_fanout(left, twice, "k", "test")
    with pytest.raises(ValueError):
        quality.require_unique(spark.createDataFrame([(None,)], "k string"), ["k"], "test")
    with pytest.raises(ValueError):
        quality.require_parents(left, "k", twice, "k", "test")
    assert quality.join_without_fanout(left, twice.limit(1), "k", "test").count() == 2


def test_metrics(spark):
    results = spark.createDataFrame([("q", d, k + 1) for k, d in enumerate("abc")], "query_id string, doc_id string, rank int")
    relevant = spark.createDataFrame([("q", d) for d in "acd"], "query_id string, doc_id string")
    m = E.ranking_metrics(results, relevant, 3).first()
    assert isclose(m["precision"], 2 / 3) and isclose(m["recall"], 2 / 3) and m["hit"] == 1.0
    labels = "id int, label string"
    expected = spark.createDataFrame([(1, "a"), (1, "b"), (2, "b")], labels)
    predicted = spark.createDataFrame([(1, "a"), (2, "b"), (2, "c")], labels)
    rows = {r["label"]: r for r in E.multilabel_metrics(expected, predicted).collect()}
    assert isclose(rows["micro"]["f1"], 2 / 3) and rows["a"]["f1"] == 1 and rows["c"]["support"] == 0
    assert E.exact_match(expected, predicted).first()[0] == 0
    k = E.kappa(spark.createDataFrame([(1, 1), (0, 0), (1, 1), (1, 0)], "a int, b int")).first()
    assert (k["agreement"], k["kappa"]) == (0.75, 0.5)
    same = spark.createDataFrame([(k, 1.0) for k in range(5)], "query_id int, score double")
    assert tuple(E.bootstrap(same.limit(0)).first()) == (0, 0.0, 0.0, 0.0) and tuple(E.bootstrap(same).first()) == (5, 1.0, 1.0, 1.0)
    runs = spark.createDataFrame([("A", 1, 2.0, 100), ("A", 1, 4.0, 100)], "workload string, factor int, seconds double, rows long")
    s = scaling.run_summary(runs).first()
    assert s["mean_seconds"] == 3.0 and isclose(s["stddev_seconds"], 2**0.5) and s["throughput"] == 37.5


def test_replicas_keep_keys(spark):
    df = spark.createDataFrame([("o", ["p"])], "order_id string, product_ids array<string>")
    got = sorted(scaling.replicate(df, 2, ["order_id", "product_ids"]).select("order_id", "product_ids").collect())
    assert [(r[0], r[1]) for r in got] == [("o__copy_0", ["p__copy_0"]), ("o__copy_1", ["p__copy_1"])]


def test_interpreter():
    q = answers.interpret("Perché il rating di mobili per ufficio è calato a marzo 2018?")
    assert (q.intent, q.metric, q.filters) == ("explain_rating_drop", "average_rating", kpi.Filters("office_furniture", None, "2018-03", "2018-03"))
    assert answers.interpret("Quali problemi di rimborso?").theme == "service_or_refund"
    assert answers.interpret("Quanti ordini? volume ordini").intent == "descriptive_only"
    assert answers.insufficient(q, 5, 2, 0.1, None, {"non_delivery": 1}) == "no rating drop is observed"
    assert answers.insufficient(q, 5, 2, -0.1, None, {"non_delivery": 1}) is None
    with pytest.raises(ValueError):
        answers.interpret("  ")
