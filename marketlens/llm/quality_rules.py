"""Quality rules by distribution divergence, with DataFrame functions only.

A document's histogram of character classes and of its language's common words is compared with the language's own
histogram over the whole corpus by Jensen-Shannon distance (square root of the divergence in bits, 0 to 1). Short texts
scatter, so each distance counts only from a least length on, and the limit on words falls with the square root of the
number of words.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE_PATTERN, WHITE, free_name, materialise

# Frequent function words of each language, by falling frequency.
COMMON_WORDS = {
    "de": "der die und in den von zu das sich mit des auf für ist im nicht dem ein eine als",
    "en": "the of and to a in is that it for was on with as be by are this at from",
    "es": "de la que el en y los las se del un por con no una su para es al lo",
    "fr": "de la le et les en des un du une que est pour par dans avec qui pas sur au",
}
#: Character classes, each what the ones before it leave: the last holds the rest (symbols). Digits are not compared:
#: how many a text has depends on its subject (years, prices, tables), not on its language.
CLASSES = ("[a-z]+", SPACE_PATTERN, "[A-Z]+", "[0-9]+", "[^\\x00-\\x7F]+", "[.,;:'\"?()\\-]+")
DIGITS = 3


@dataclass(frozen=True)
class Limits:
    """Guards and limits. A distance is compared from ``least_chars`` counted characters or ``least_words`` words on."""

    least_chars: int = 200
    char_distance: float = 0.2
    least_words: int = 50
    word_distance: float = 0.2
    word_scatter: float = 1.0
    languages: dict[str, str] = field(default_factory=lambda: dict(COMMON_WORDS))

    def __hash__(self) -> int:
        return hash((self.least_chars, self.char_distance, self.least_words, self.word_distance, self.word_scatter, *sorted(self.languages.items())))


def _among(words: str) -> Callable[[Column], Column]:
    return lambda x: x.isin(words.split())


def _staged(df: DataFrame, names: dict[str, str], text: Column) -> DataFrame:
    """``df`` with the character lengths after each removal, each step a column of its own so that none runs twice."""
    df = df.withColumn(names["left0"], text)
    for k, pattern in enumerate(CLASSES):
        df = df.withColumn(names[f"left{k + 1}"], F.regexp_replace(F.col(names[f"left{k}"]), pattern, ""))
    return df


def histograms(docs: DataFrame, limits: Limits, text: str = "text", lang: str = "lang") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with working columns: ``key`` (configured language or null), ``chars`` and ``common`` (array<double>),
    ``lefts`` (characters left after each removal). The second result has their names, none of which ``docs`` has."""
    wanted = ["key", "chars", "common", "n_tokens", "hits", *[f"left{k}" for k in range(len(CLASSES) + 1)]]
    names = {w: free_name(docs, f"_{w}") for w in wanted}
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    df = _staged(docs, names, value)
    lengths = [F.length(names[f"left{k}"]) for k in range(len(CLASSES) + 1)]
    steps = [(a - b).cast("double") for a, b in zip(lengths, lengths[1:], strict=False)] + [lengths[-1].cast("double")]
    df = df.withColumn(names["chars"], F.array(*[s for k, s in enumerate(steps) if k != DIGITS]))
    tokens = F.split(F.lower(value), "[.,;:!?]*" + SPACE_PATTERN)
    every = sorted({w for x in limits.languages.values() for w in x.split()})
    df = df.withColumn(names["hits"], F.struct(F.filter(tokens, _among(" ".join(every))).alias("words"), F.size(tokens).alias("n")))
    df = df.withColumn(names["n_tokens"], F.col(f"{names['hits']}.n"))
    words = F.col(f"{names['hits']}.words")
    of = {k: F.size(F.filter(words, _among(v))) for k, v in limits.languages.items()}
    best = F.greatest(*of.values(), F.lit(0)) if len(of) > 1 else next(iter(of.values()))
    guess = F.lit(None).cast("string")
    for k in sorted(of, reverse=True):
        guess = F.when((of[k] == best) & (best > 0), F.lit(k)).otherwise(guess)
    known = F.col(lang).isin(list(limits.languages)) if lang in docs.columns else F.lit(False)
    df = df.withColumn(names["key"], F.when(known, F.col(lang) if lang in docs.columns else guess).otherwise(guess))
    common = F.lit(None).cast("array<double>")
    for k, v in limits.languages.items():
        counts = [F.size(F.filter(words, _among(w))).cast("double") for w in v.split()]
        common = F.when(F.col(names["key"]) == k, F.array(*counts)).otherwise(common)
    return df.withColumn(names["common"], common), names


def references(counted: DataFrame, limits: Limits, n: dict[str, str]) -> dict[str, tuple[list[float], list[float]]]:
    """Each configured language's character-class and common-word counts, summed over all documents of ``histograms``. The
    last bin of the words holds all others. One row a configured language reaches the driver, whatever the corpus holds."""
    some = max(limits.languages.values(), key=lambda v: len(v.split()), default="")
    chars = [F.sum(F.col(n["chars"])[k]).alias(f"c{k}") for k in range(len(CLASSES))]
    words = [F.sum(F.get(F.col(n["common"]), F.lit(k))).alias(f"w{k}") for k in range(len(some.split()))]
    rows = counted.where(F.col(n["key"]).isNotNull()).groupBy(F.col(n["key"]).alias("key")).agg(*chars, *words, F.sum(n["n_tokens"]).alias("n")).collect()
    out = {}
    for r in rows:
        w = [float(r[f"w{k}"] or 0) for k in range(len(limits.languages[r["key"]].split()))]
        out[r["key"]] = ([float(r[f"c{k}"] or 0) for k in range(len(CLASSES))], [*w, max(0.0, float(r["n"] or 0) - sum(w))])
    return out


def js_distance(counts: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of an array of counts from reference counts; null for no counts or no reference."""
    total = sum(reference)
    if not total:
        return F.lit(None).cast("double")
    q = F.array(*[F.lit(x / total) for x in reference])
    n = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)

    def part(x: Column, m: Column) -> Column:
        return F.when(x > 0, x * F.log2(x / m)).otherwise(0.0)

    # the sum over bins of what each side gives against their mean
    terms = F.zip_with(counts, q, lambda c, r: F.struct((c / n).alias("p"), r.alias("q")))
    bits = F.aggregate(terms, F.lit(0.0), lambda a, t: a + part(t["p"], (t["p"] + t["q"]) / 2) + part(t["q"], (t["p"] + t["q"]) / 2))
    return F.when(n > 0, F.sqrt(F.greatest(bits / 2, F.lit(0.0))))


def measure(docs: DataFrame, limits: Limits = Limits(), text: str = "text", lang: str = "lang", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (of its columns those in ``keep``, by default all) with n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words (long), char_distance, word_distance (double, null where not compared), base_failed and kept (boolean);
    input columns of these names are replaced.

    Words are runs of other characters than space and \\x09-\\x0D. base_failed: fewer than 10 words, or over 20 % of the
    words in 5-word windows that the text holds twice or more. kept: base passed and no compared distance over its limit.
    Null and empty texts have zero counts and fail; very long ones are counted whole. A null or unconfigured language is
    guessed by the most common words, of equally many the first by name; where none occurs, only the character classes are
    compared, with the closest language's. References are sums over all documents of a language, failed ones too: the
    yardstick is the corpus as it came, and does not depend on the rules' order. Repeated rows are measured each; an empty
    table gives no rows. The texts are read once: their counts (with the columns to keep) are written to the shared folder,
    where the references are summed and each document is judged. No row leaves its partition.
    """
    new = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "char_distance", "word_distance", "base_failed", "kept")
    plain = docs.drop(*[c for c in docs.columns if c.lower() in new])
    kept = [c for c in plain.columns if keep is None or c in keep]
    df, n = histograms(plain, limits, text, lang)
    own = {k: free_name(df, f"_{k}") for k in ("words", "hash", "windows", "sorted", "places")}
    value = F.col(n["left0"])
    trimmed = F.btrim(value, F.lit(WHITE))
    df = df.withColumn(own["words"], F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_PATTERN)))
    df = df.withColumn(own["hash"], F.transform(own["words"], lambda x: F.xxhash64(x)))
    h, size = F.col(own["hash"]), F.size(own["words"])
    windows = F.transform(F.sequence(F.lit(0), size - 5), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(5)]))
    df = df.withColumn(own["windows"], F.when(size >= 5, windows).otherwise(F.array().cast("array<bigint>")))
    w = F.col(own["windows"])
    repeats = F.size(F.array_distinct(w)) < F.size(w)
    placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
    df = df.withColumn(own["sorted"], F.when(repeats, placed))
    s = F.col(own["sorted"])
    again = F.filter(s, lambda x, i: (F.get(s, i - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, i + 1)["h"].eqNullSafe(x["h"])))
    df = df.withColumn(own["places"], F.sort_array(F.transform(again, lambda x: x["i"])))
    p = F.col(own["places"])
    covered = F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(5), F.coalesce(F.get(p, i + 1) - x, F.lit(5)))), F.lit(0), lambda a, x: a + x)
    lines = F.filter(F.split(value, "\n"), lambda x: F.btrim(x, F.lit(WHITE)) != "")
    length = [F.length(n[f"left{k}"]) for k in range(len(CLASSES) + 1)]
    symbols = F.col(n[f"left{len(CLASSES)}"])
    counts = {
        "n_words": size.cast("long"),
        "word_chars": (length[0] - (length[1] - length[2])).cast("long"),
        "n_symbols": (F.length(symbols) - F.length(F.translate(symbols, "#*$%&|<>", ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0)).cast("long"),
    }
    narrow = [F.col(f"`{c}`") for c in kept] + [F.col(n[c]) for c in ("key", "chars", "common", "n_tokens")]
    df = materialise(df.select(*narrow, *[c.alias(name) for name, c in counts.items()]), "quality-counts")
    refs = references(df, limits, n)
    chars, words = F.lit(None).cast("double"), F.lit(None).cast("double")
    total = F.aggregate(F.col(n["chars"]), F.lit(0.0), lambda a, x: a + x)
    common = F.col(n["common"])
    rest = F.col(n["n_tokens"]).cast("double") - F.aggregate(common, F.lit(0.0), lambda a, x: a + x)
    for k, (c, v) in sorted(refs.items()):
        here = F.col(n["key"]) == k
        chars = F.when(here & (total >= limits.least_chars), js_distance(F.col(n["chars"]), c)).otherwise(chars)
        words = F.when(here & (F.col("n_words") >= limits.least_words), js_distance(F.concat(common, F.array(rest)), v)).otherwise(words)
    nearest = [js_distance(F.col(n["chars"]), c) for _, (c, _) in sorted(refs.items())]
    if nearest:
        unknown = F.col(n["key"]).isNull() & (total >= limits.least_chars)
        chars = F.when(unknown, F.least(*nearest) if len(nearest) > 1 else nearest[0]).otherwise(chars)
    df = df.withColumns({"char_distance": chars, "word_distance": words})
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    df = df.withColumn("base_failed", failed)
    limit = limits.word_distance + limits.word_scatter / F.sqrt("n_words")
    near = ~F.coalesce(F.col("char_distance") > limits.char_distance, F.lit(False)) & ~F.coalesce(F.col("word_distance") > limit, F.lit(False))
    return df.select(*[F.col(f"`{c}`") for c in kept], *new[:-1], (~F.col("base_failed") & near).alias("kept"))
