"""Bucketed tables and what is built on them, questions over a table, and samples by assignment."""

import itertools
import os
import random

import pytest
from pyspark.sql import functions as F

from marketlens.operators import answers, index, questions, retrieval, sampling
from marketlens.sources.bucketed import BucketTable

DOCS = "document_id string, document_hash string, metadata_hash string, document_text string"


def embedded(rows):
    return rows.withColumn("embedding", F.array(F.length("document_text").cast("float")))


def files_of(path):
    return {os.path.join(a, f): os.stat(os.path.join(a, f)).st_mtime_ns for a, _, fs in os.walk(f"{path}/data") for f in fs if f.endswith(".parquet")}


def test_a_sync_writes_only_touched_buckets(spark, tmp_path):
    at = BucketTable(spark, f"{tmp_path}/index", "document_id", 16)
    docs = [(f"d{k}", "1", "1", "x" * (k % 7)) for k in range(400)]
    frame = lambda rows: spark.createDataFrame(rows, DOCS)
    one, counters = index.synchronise_buckets(frame(docs), at, embedded, "m", "1")
    assert counters["documents_upserted"] == 400 and one.number == 1 and len(one.held) == 16
    before = files_of(at.path)
    old = at.read(one)
    changed = [("d0", "2", "1", "yy"), *docs[1:5], ("d5", "1", "2", docs[5][3]), *docs[7:], ("new", "1", "1", "z")]
    two, counters = index.synchronise_buckets(frame(changed), at, embedded, "m", "1")
    assert {k: v for k, v in counters.items() if k.startswith(("documents_u", "documents_m", "stale"))} == {"documents_upserted": 2, "documents_metadata_updated": 1, "stale_documents_removed": 1}
    touched = {r[0] for r in frame([("d0", "", "", ""), ("d5", "", "", ""), ("d6", "", "", ""), ("new", "", "", "")]).select(at.bucket_of(16)).collect()}
    assert {b for b, v in two.held.items() if v.startswith("2-")} == touched and len(touched) < 6
    after = files_of(at.path)
    assert before.items() <= after.items()  # nothing that was there is changed
    assert {f.split("bucket=")[1].split("/")[0] for f in after.keys() - before.keys()} == {str(b) for b in touched}
    assert old.count() == 400 and {r[0] for r in old.where("document_id = 'd0'").select("document_hash").collect()} == {"1"}  # a reader keeps its version
    got = sorted((r["document_id"], r["document_hash"], r["metadata_hash"], r["embedding"][0]) for r in at.read().collect())
    assert got == sorted((i, h, m, float(len(t))) for i, h, m, t in changed)
    same, _ = index.synchronise_buckets(frame(changed), at, embedded, "m", "1")
    assert same.number == 2 and files_of(at.path) == after
    with pytest.raises(ValueError, match="another writer"):
        at.replace(at.read(two, [0]).limit(0), [0], one)
    with pytest.raises(ValueError, match="another model"):
        index.synchronise_buckets(frame(changed), at, embedded, "m", "2")
    with pytest.raises(ValueError, match="repeated"):
        index.synchronise_buckets(frame(changed + changed[:1]), at, embedded, "m", "1")
    assert at.vacuum() == [1] and at.numbers() == [2]
    assert at.read().count() == len(changed) and len(files_of(at.path)) < len(after)
    gone, _ = index.synchronise_buckets(frame([]), at, embedded, "m", "1")
    assert gone.held == {} and at.read().count() == 0
    assert BucketTable(spark, f"{tmp_path}/none", "document_id").read() is None


def test_stored_translations(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def slow(text):
        calls.add(1)
        if text == "bad":
            raise RuntimeError
        return text.upper()

    cache = BucketTable(spark, f"{tmp_path}/cache", "source_hash", 8)
    rows = spark.createDataFrame([(1, "a"), (2, "bad"), (3, "c"), (4, None), *[(k, "hot") for k in range(5, 300)]], "id int, source_text string").repartition(5)
    done, one = retrieval.translate_stored(rows, cache, slow, "1", "it")
    got = {r["id"]: (r["translated_text"], r["status"]) for r in done.collect()}
    assert len(got) == done.count() == 299 and got[7] == ("HOT", "translated") and got[2] == (None, "failed_original_available") and got[4] == (None, "empty")
    assert calls.value == 4  # a, bad, c and hot once each
    before = files_of(cache.path)
    more = rows.where("id <> 2").unionByName(spark.createDataFrame([(900, "new")], rows.schema))
    done, two = retrieval.translate_stored(more, cache, slow, "1", "it")
    assert calls.value == 5 and {r[0] for r in done.where("id not in (4, 900)").select("status").distinct().collect()} == {"cached"}
    assert sum(v.startswith(f"{two.number}-") for v in two.held.values()) == 1 and before.items() <= files_of(cache.path).items()
    _, three = retrieval.translate_stored(more, cache, lambda t: t + "!", "2", "it")
    held = {r["translated_text"]: r["translator_version"] for r in cache.read(three).collect()}
    assert held == {"a!": "2", "c!": "2", "hot!": "2", "new!": "2"}
    retrieval.translate_stored(more, cache, str.title, "1", "en")
    assert cache.read().count() == 8
    none, same = retrieval.translate_stored(rows.limit(0), cache, slow, "2", "it")
    assert none.count() == 0 and same.number == cache.version().number


def test_questions_as_interpreted_one_by_one(spark):
    draw = random.Random(5)
    words = [*answers.CATEGORIES, *itertools.chain(*answers.THEME_NAMES.values()), *(s for gs in answers.STEMS.values() for g in gs for s in g)]
    words += ["Perché", "QUALITÀ", "casa_e_giardino", "2018-03", "2017-01", "marzo 2018", "Aprile  2017", "e", "non", "2018-13"]
    texts = [" ".join(draw.choices(words, k=draw.randint(1, 5))) for _ in range(600)] + ["", "   ", "2018-03 e 2017-01", "x" * 200_000 + " ritardo", "rimborso resi", "İstanbul ritardo", None]
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "id int, text string, valid string").repartition(4)
    got = {r["id"]: r["question"] for r in questions.interpret_table(df).collect()}
    assert len(got) == len(texts)
    wrong_order = 0
    for k, t in enumerate(texts):
        try:
            q = answers.interpret(t)
        except ValueError:
            assert not got[k]["valid"]
            wrong_order += got[k]["start_month"] is not None
            continue
        f = q.filters
        assert tuple(got[k]) == (q.intent, q.metric, q.theme, f.category, f.start_month, f.end_month, True), t
    assert wrong_order
    assert questions.interpret_table(df.limit(0)).count() == 0


def test_a_sample_is_found_whenever_one_exists(spark):
    assert sampling.assigned({"a": [1, 2, 3], "b": [1, 4]}, 1) == {"a": [1], "b": [4]}
    assert sampling.assigned({"a": [1, 2], "b": [1]}, 1) == {"a": [2], "b": [1]}
    assert sampling.assigned({"a": [1, 2], "b": [1, 3], "c": [3]}, 1) == {"a": [2], "b": [1], "c": [3]}
    draw = random.Random(2)
    for _ in range(300):
        choices = {g: draw.sample(range(7), draw.randint(1, 5)) for g in "abc"}
        per = draw.randint(1, 2)
        exists = any(
            not (set(x) & set(y) or set(x) & set(z) or set(y) & set(z))
            for x, y, z in itertools.product(*(itertools.combinations(v, per) for v in choices.values()))
        )
        try:
            got = sampling.assigned(choices, per)
        except ValueError:
            assert not exists
            continue
        taken = list(itertools.chain(*got.values()))
        assert exists and len(taken) == len(set(taken)) == 3 * per and all(set(v) <= set(choices[g]) for g, v in got.items())
    # greedy takes the rows of the smaller group first, and fails
    rows = [(k, ["wide", "narrow"]) for k in range(4)] + [(10 + k, ["wide"]) for k in range(4)] + [(None, ["narrow"]), (1, ["wide", "narrow"])]
    df = spark.createDataFrame(rows, "id int, groups array<string>")
    got = sampling.balanced(df, ["wide", "narrow"], 4, "groups", "id").collect()
    assert {r["id"] for r in got if r["stratum"] == "narrow"} == {0, 1, 2, 3} and len({r["id"] for r in got}) == 8
    with pytest.raises(ValueError, match="not enough"):
        sampling.balanced(df, ["narrow", "wide"], 5, "groups", "id")
