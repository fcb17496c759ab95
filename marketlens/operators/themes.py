"""Multi-label theme classification, prevalence and ranked evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marketlens.functions import scalar as S
from marketlens.functions import theme_rules as R
from marketlens.operators import kpi
from marketlens.operators.eda import negative


def rag_eligible() -> Column:
    return F.col("text_is_eligible") & S.is_meaningful(F.col("review_text"))


def _rules(version: str, rules: dict[str, str] | None) -> dict[str, str]:
    return rules or (R.RULES_V2 if version == "rules-pt-v2" else R.RULES_V3)


def _hits(plain: Column, rules: dict[str, str]) -> Column:
    """Whether each rule matches ``letters_only`` text."""
    return F.array(*[plain.rlike(R.whole_words(p)) for p in rules.values()])


def _decided(plain: Column, hits: Column, version: str, rules: dict[str, str]) -> Column:
    found = F.array_compact(F.array(*[F.when(hits[i], F.lit(t)) for i, t in enumerate(rules)]))
    positive = F.lit(False) if version == "rules-pt-v2" else plain.rlike(R.whole_words(R.POSITIVE))
    other = F.when(positive, F.array(F.lit("other"))).when(~S.has_words(plain, 4), F.array(F.lit("uncertain"))).otherwise(F.array(F.lit("other")))
    return F.when(F.array_contains(hits, True), found).otherwise(other)


def theme_array(text: Column, version: str = "rules-pt-v3", rules: dict[str, str] | None = None) -> Column:
    """The themes that match, else ``other`` for a positive text (not in v2), ``uncertain`` below four words, or ``other``.
    Any version but ``rules-pt-v2`` means v3. For few texts: tables go through ``with_theme_array``."""
    plain, rules = S.letters_only(text), _rules(version, rules)
    return _decided(plain, _hits(plain, rules), version, rules)


def with_theme_array(rows: DataFrame, text: Column, version: str = "rules-pt-v3", rules: dict[str, str] | None = None) -> DataFrame:
    """``rows`` with ``themes``, the ``theme_array`` of ``text``. The normalised text and what the rules say are steps of their
    own: a text is normalised once and read by each rule once, however often either is used."""
    return plain_themes(rows.withColumn("_plain", S.letters_only(text)), version, rules).drop("_plain")


def plain_themes(rows: DataFrame, version: str = "rules-pt-v3", rules: dict[str, str] | None = None) -> DataFrame:
    """``with_theme_array`` of rows whose ``_plain`` is text that ``letters_only`` has made."""
    plain, rules = F.col("_plain"), _rules(version, rules)
    return rows.withColumn("_hits", _hits(plain, rules)).withColumn("themes", _decided(plain, F.col("_hits"), version, rules)).drop("_hits")


def classify(reviews: DataFrame, version: str = "rules-pt-v3", rules: dict[str, str] | None = None) -> DataFrame:
    """One row per eligible review and theme."""
    rows = with_theme_array(reviews.where(rag_eligible()).select("review_id", "review_score", "review_text"), F.col("review_text"), version, rules)
    long = rows.select("review_id", "review_score", F.explode("themes").alias("theme"))
    return long.dropDuplicates(["review_id", "theme"]).select(
        "review_id", "review_score", "theme", F.lit(None).cast("double").alias("classification_score"), F.lit(version).alias("classifier_version"),
        F.lit("deterministic_rule_based_multilabel").alias("classification_method"),
    )


def classify_negative(reviews: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """(review_id, theme) of the exploration tables: reviews of a score up to 2 with eligible text (however little it says),
    by the older rules, which know no praise."""
    some = reviews.where((negative() == 1) & F.col("text_is_eligible"))
    return with_theme_array(some.select("review_id", "review_text"), F.col("review_text"), "rules-pt-v2", rules).select("review_id", F.explode("themes").alias("theme")).distinct()


def annotated(reviews: DataFrame, version: str = "rules-pt-v3", rules: dict[str, str] | None = None) -> DataFrame:
    """``reviews`` (one row a review) with ``rag``, whether their text is eligible, and ``themes``, its distinct themes in
    order (none where it is not): texts are read once, and what follows needs no join to find a review's themes."""
    rows = reviews.withColumn("_plain", S.letters_only(F.col("review_text")))  # a step of its own: used by every pattern
    rows = rows.withColumn("rag", F.coalesce(F.col("text_is_eligible") & S.has_word(F.col("_plain")), F.lit(False)))
    none = F.array().cast("array<string>")
    found = F.array_sort(F.array_distinct("themes"))
    return plain_themes(rows, version, rules).withColumn("themes", F.when(F.col("rag"), found).otherwise(none)).drop("_plain")


def with_themes(reviews: DataFrame, themes: DataFrame) -> DataFrame:
    """``annotated`` from a stored (review_id, theme) table."""
    sets = themes.groupBy("review_id").agg(S.sorted_set(F.col("theme")).alias("themes"))
    return reviews.drop("themes").join(sets, "review_id", "left").withColumns({"rag": F.coalesce(rag_eligible(), F.lit(False)), "themes": F.coalesce("themes", F.array().cast("array<string>"))})


def negative_with_text(reviews: DataFrame) -> DataFrame:
    return reviews.where((negative() == 1) & F.col("rag"))


def _mentions(reviews: DataFrame, *by: str) -> DataFrame:
    """(by, theme, n): negative reviews with text of each theme, and with a null theme all of them: one explode, one sum."""
    rows = negative_with_text(reviews).dropna(subset=list(by) or None, how="any") if by else negative_with_text(reviews)
    return rows.select(*by, F.explode(F.array_append("themes", F.lit(None))).alias("theme")).groupBy(*by, "theme").agg(F.count(F.lit(1)).alias("n"))


def counts(reviews: DataFrame) -> DataFrame:
    """(theme, mentions) over eligible negative reviews of ``annotated`` reviews."""
    return _mentions(reviews).where("theme is not null").withColumnRenamed("n", "mentions")


def prevalence(reviews: DataFrame) -> DataFrame:
    """(theme, review_count, prevalence) over negative reviews with text."""
    total = F.max(F.when(F.col("theme").isNull(), F.col("n"))).over(Window.partitionBy())  # a row a theme
    n = _mentions(reviews).withColumn("total", total).where("theme is not null")
    return n.select("theme", F.col("n").alias("review_count"), S.rate(F.col("n"), F.col("total")).alias("prevalence"))


def themes_by(reviews: DataFrame, *by: str) -> DataFrame:
    """Theme shares within groups of negative reviews with text; groups without a known value are left out."""
    total = F.max(F.when(F.col("theme").isNull(), F.col("n"))).over(Window.partitionBy(*by))  # a row a theme and group
    n = _mentions(reviews, *by).withColumn("negative_text_reviews", total).where("theme is not null")
    return n.select(*by, "theme", F.col("n").alias("review_count"), "negative_text_reviews", S.rate(F.col("n"), F.col("negative_text_reviews")).alias("share"))


def population(reviews: DataFrame, *by: str) -> DataFrame:
    n = F.count(F.lit(1))
    neg, text = negative() == 1, rag_eligible()
    return reviews.groupBy(*by).agg(
        n.alias("total_reviews"), F.count_if(text).alias("text_reviews"), F.count_if(neg).alias("negative_reviews"), F.count_if(neg & text).alias("negative_text_reviews"),
        S.rate(F.count_if(text), n).alias("text_coverage"), S.rate(F.count_if(neg & text), F.count_if(neg)).alias("negative_text_coverage"),
    )


def evidence(reviews: DataFrame, filters: kpi.Filters, names: tuple[str, ...] = R.THEMES) -> DataFrame:
    """One row per theme, zero rows included: mentions and rates now and in the baseline months, and the change, over
    ``annotated`` reviews: all counts come from one aggregation."""
    tagged = negative_with_text(kpi._tagged(reviews, filters, "reviews"))
    inside = {"current": F.col("window") == "current", "baseline": F.col("window") == "baseline"}
    found = tagged.agg(*[F.count_if(on).alias(w) for w, on in inside.items()], *[F.count_if(on & F.array_contains("themes", t)).alias(f"{w}_{t}") for w, on in inside.items() for t in names])
    each = F.explode(F.array(*[F.struct(F.lit(t).alias("theme"), F.col(f"current_{t}").alias("now"), F.col(f"baseline_{t}").alias("then")) for t in names]))
    rows = found.select("current", "baseline", each.alias("t"))
    now, then = S.rate(F.col("t.now"), F.col("current")), S.rate(F.col("t.then"), F.col("baseline"))
    return rows.select(
        "t.theme", F.col("t.now").alias("current_mentions"), now.alias("current_rate"), F.col("t.then").alias("baseline_mentions"), then.alias("baseline_rate"), (now - then).alias("rate_change"),
        (~F.col("t.theme").isin(*R.FALLBACK)).alias("is_candidate"),
    )


def ranked(evidence_rows: DataFrame) -> DataFrame:
    """Candidates with mentions, by change (or current rate), rate, mentions and name."""
    order = Window.orderBy(F.desc(F.coalesce("rate_change", "current_rate")), F.desc("current_rate"), F.desc("current_mentions"), "theme")  # a row a theme
    return evidence_rows.where("is_candidate and current_mentions > 0").withColumn("rank", F.row_number().over(order))


def require_one_version(themes: DataFrame) -> None:
    if len(themes.select("classifier_version").distinct().take(2)) != 1:
        raise ValueError("themes must have one classifier version")
