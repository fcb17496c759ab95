"""Column functions of the cleaning, feature and text operators. All are built-in expressions."""

from __future__ import annotations

from datetime import date
from decimal import Decimal
from functools import reduce
from math import isfinite

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Trimmed text; blank becomes null."""
    t = F.trim(c)
    return F.when(t != "", t)


def category(c: Column) -> Column:
    return F.lower(trimmed(c))


def state(c: Column) -> Column:
    return F.upper(trimmed(c))


def typed(c: Column, kind: str) -> Column:
    """Cast of trimmed text; what does not fit becomes null instead of an error."""
    return trimmed(c).try_cast(kind)


def timestamp(c: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    return F.try_to_timestamp(trimmed(c), F.lit(pattern))


def days_between(later: Column, earlier: Column) -> Column:
    """Days with three decimals; null if either end is missing."""
    return F.round((later.cast("long") - earlier.cast("long")) / F.lit(86400.0), 3)


def is_later(actual: Column, promised: Column) -> Column:
    """Three-valued: null unless both dates are known."""
    return F.when(actual.isNotNull() & promised.isNotNull(), actual > promised)


def rate(numerator: Column, denominator: Column) -> Column:
    """Null on a zero or missing denominator."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def exact_mean(total: Column, n: Column, scale: str = "decimal(18,2)") -> Column:
    """Mean from an exact decimal sum, so that the order of addition does not matter."""
    return F.try_divide(total.cast(scale).cast("double"), n.cast("double"))


def review_text(title: Column, message: Column) -> Column:
    """Title and message joined by a blank line, of the non-blank ones; null if neither."""
    joined = F.concat_ws("\n\n", trimmed(title), trimmed(message))
    return F.when(joined != "", joined)


def document_text(title: Column, message: Column) -> Column:
    t, m = trimmed(title), trimmed(message)
    return (
        F.when(t.isNotNull() & m.isNotNull(), F.concat(F.lit("Title: "), t, F.lit("\nComment: "), m))
        .when(t.isNotNull(), F.concat(F.lit("Title: "), t))
        .when(m.isNotNull(), F.concat(F.lit("Comment: "), m))
    )


def text_source(title: Column, message: Column) -> Column:
    t, m = trimmed(title), trimmed(message)
    return F.when(t.isNotNull() & m.isNotNull(), "title_and_message").when(t.isNotNull(), "title").when(m.isNotNull(), "message")


def letters_only(c: Column) -> Column:
    """Lower-cased runs of letters joined by single spaces; null gives ''."""
    return F.trim(F.lower(F.regexp_replace(F.coalesce(c, F.lit("")), r"[^\p{L}]+", " ")))


def is_meaningful(c: Column) -> Column:
    """Some run of two or more letters."""
    return has_word(letters_only(c))


def has_word(plain: Column) -> Column:
    """Whether ``letters_only`` text has a word of two or more letters; found where the first is."""
    return plain.rlike("[^ ]{2}")


def has_words(plain: Column, n: int) -> Column:
    """Whether ``letters_only`` text has ``n`` words of two or more letters; read up to the last of them."""
    return plain.rlike(f"^(?:(?:[^ ] )*+[^ ]{{2,}}+(?: |$)){{{n}}}")


#: Stop words by language for the language heuristic on the synthetic corpus and on reviews.
STOP_WORDS = {
    "de": "der die und in den von zu das sich mit des auf ist im nicht dem ein eine als",
    "en": "the of and to a in is that it for was on with as be by are this",
    "es": "de la que el en y los las se del un por con no una su para es",
    "fr": "de la le et les en des un du une que est pour par dans avec qui",
}


# Words by which a review's language is told, and the name of a language that can't be told.
REVIEW_WORDS = {
    "pt": "não nao muito produto entrega chegou com para que uma bom ruim recebi prazo ainda foi mas meu minha comprar recomendo",
    "es": "no muy producto entrega llegó con para que una bueno malo recibí plazo todavía pero recomiendo comprar",
    "en": "not very product delivery arrived with for the good bad received late still but recommend buy",
    "it": "non molto prodotto consegna arrivato con per che una buono cattivo ricevuto ritardo ancora ma consiglio comprare",
}
UNKNOWN = "unknown_or_ambiguous"


def review_language(c: Column) -> Column:
    """The language of a review: pt, es, en, it, or ``UNKNOWN``."""
    return language(c, REVIEW_WORDS, UNKNOWN)


def language(c: Column, lists: dict[str, str] | None = None, unknown: str = "unknown") -> Column:
    """The list with most distinct words in the text; ``unknown`` below 3 words of 2 letters, under 2 hits or on a tie."""
    lists = lists or STOP_WORDS
    words = F.filter(F.array_distinct(F.split(letters_only(c), " ")), lambda w: F.length(w) > 1)
    hits = {k: F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in v.split()]))) for k, v in lists.items()}
    best = F.greatest(*hits.values())
    ties = reduce(lambda a, b: a + b, [(h == best).cast("int") for h in hits.values()])
    name = reduce(lambda out, k: F.when(hits[k] == best, F.lit(k)).otherwise(out), sorted(hits, reverse=True), F.lit(unknown))
    return F.when((F.size(words) < 3) | (best < 2) | (ties > 1), unknown).otherwise(name)


def month_index(date: Column) -> Column:
    return F.year(date) * 12 + F.month(date)


def month_label(date: Column) -> Column:
    return F.format_string("%04d-%02d", F.year(date), F.month(date))


def sorted_set(c: Column) -> Column:
    return F.sort_array(F.collect_set(c))


def flattened_set(c: Column) -> Column:
    """The distinct elements of all arrays of the group, sorted."""
    return F.sort_array(F.array_distinct(F.flatten(F.collect_set(c))))


def unanimous(c: Column) -> Column:
    """The value that every row of the group has; null if one is missing or two differ."""
    return F.when((F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c)), F.min(c))


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fold_accents(c: Column) -> Column:
    return F.translate(c, "àáâãäèéêëìíîïòóôõöùúûüçñ", "aaaaaeeeeiiiiooooouuuucn")


def csv_safe(df, columns=None) -> list[Column]:
    """Array, map and struct columns as JSON text, decimals as floats, others as they are."""
    from pyspark.sql import types as T

    def safe(f: T.StructField) -> Column:
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name).cast("double").alias(f.name) if isinstance(f.dataType, T.DecimalType) else F.col(f.name)

    return [safe(f) for f in df.schema.fields]


def native(value):
    """A value as JSON has it: decimals as floats, dates in ISO form, infinite and undefined numbers as null; inside lists
    and dictionaries too."""
    if isinstance(value, dict):
        return {k: native(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [native(v) for v in value]
    if isinstance(value, Decimal):
        value = float(value)
    if isinstance(value, float) and not isfinite(value):
        return None
    return value.isoformat() if isinstance(value, date) else value
