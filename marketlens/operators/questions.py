"""Controlled questions over a table of texts: one pass of an automaton over each text finds all names and stems at once."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marketlens.operators import answers as A
from marketlens.operators.kpi import Filters

FOUND = "intent string, metric string, theme string, category string, start_month string, end_month string, valid boolean"


def automaton() -> ahocorasick.Automaton:
    """What each name or stem stands for: (kind, what). A string that stands for several things holds all of them."""
    means: dict[str, list[tuple[str, object]]] = {}
    for place, (name, category) in enumerate(A.CATEGORIES.items()):
        means.setdefault(name, []).append(("category", (len(name), -place, category)))  # the longest, of those the first listed
    for theme, names in A.THEME_NAMES.items():
        for name in names:
            means.setdefault(name, []).append(("theme", (len(name), theme)))  # the longest, of those the last by name
    for subject, groups in A.STEMS.items():
        for number, stems in enumerate(groups):
            for stem in stems:
                means.setdefault(stem, []).append(("subject", (subject, number)))
    out = ahocorasick.Automaton()
    for name, what in means.items():
        out.add_word(name, what)
    out.make_automaton()
    return out


def _found(words: ahocorasick.Automaton, text: str) -> dict[str, set]:
    out: dict[str, set] = {"category": set(), "theme": set(), "subject": set()}
    for _, what in words.iter(text):
        for kind, value in what:
            out[kind].add(value)
    return out


def asked(words: ahocorasick.Automaton, text: str) -> tuple:
    """The fields of ``FOUND`` for a text, as ``answers.interpret`` infers them."""
    plain = A.folded(text)
    found = _found(words, plain)
    named = _found(words, plain.replace("_", " "))["category"] if "_" in plain else found["category"]
    theme = max(found["theme"])[1] if found["theme"] else None
    subjects = {s for s, groups in A.STEMS.items() if all((s, k) in found["subject"] for k in range(len(groups)))} | ({"complaint"} if theme else set())
    intent, metric = next(((i, m) for i, m, *choices in A.ASKED if any(set(c) <= subjects for c in choices)), ("unsupported", "unknown"))
    start, end = A.months_in(text)
    category = max(named)[2] if named else None
    try:
        filters = Filters(category, None, start, end).validated()
    except ValueError:
        return intent, metric, theme, category, start, end, False
    return intent, metric, theme, filters.category, filters.start_month, filters.end_month, True


def interpret_table(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with a column ``question`` (a struct of ``FOUND``): what each text asks for.

    The same answers as ``answers.interpret`` for one text; where that raises, for a text without a word or months in the
    wrong order, ``valid`` is false: all other fields are null for the former, as found for the latter. Null texts are empty.
    Whole texts are read, each once; only that column goes to Python, and no row is shuffled. A column named ``question`` is
    replaced. An empty table gives no rows.
    """

    @F.pandas_udf(FOUND)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        words = automaton()
        names = [c.split()[0] for c in FOUND.split(", ")]
        for batch in batches:
            yield pd.DataFrame([asked(words, t) if t and t.strip() else (None,) * 6 + (False,) for t in batch], columns=names)

    return df.withColumn("question", run(F.col(text).cast("string")))
