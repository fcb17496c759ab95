"""Controlled question interpretation, sufficiency gate and grounded answers. Plain Python on tiny inputs."""

from __future__ import annotations

import re
import unicodedata
from dataclasses import dataclass

from marketlens.operators.kpi import Filters

# Months, category names and theme names as they are asked for, and the words that decide an intent.
MONTHS = "gennaio febbraio marzo aprile maggio giugno luglio agosto settembre ottobre novembre dicembre".split()
CATEGORIES = {
    "office furniture": "office_furniture", "mobili per ufficio": "office_furniture", "arredamento per ufficio": "office_furniture", "arredamento ufficio": "office_furniture",
    "sport e tempo libero": "sports_leisure", "salute e bellezza": "health_beauty", "informatica e accessori": "computers_accessories", "casa e giardino": "housewares",
    "libri": "books_general_interest", "piccoli elettrodomestici": "small_appliances", "elettronica": "electronics", "profumeria": "perfumery", "profumi": "perfumery",
    "letto bagno e tavola": "bed_bath_table", "letto, bagno e tavola": "bed_bath_table",
}
THEME_NAMES = {
    "non_delivery": ("mancata consegna", "non consegnato", "non ricevuto", "mai arrivato"),
    "delivery_delay": ("ritardo nella consegna", "ritardi nella consegna", "consegna in ritardo", "consegne in ritardo", "ritardo", "ritardi"),
    "wrong_or_missing_item": (
        "articolo errato", "articoli errati", "prodotto errato", "prodotti errati", "articolo sbagliato", "prodotto sbagliato", "articolo mancante", "articoli mancanti",
        "parti mancanti", "prodotto incompleto", "prodotti incompleti",
    ),
    "damaged_or_defective": ("danneggiato", "danneggiati", "danneggiate", "difetto", "difetti", "difettoso", "difettosi", "rotto", "rotti", "non funzionante", "non funzionanti"),
    "quality_or_expectation": ("qualita", "aspettative", "diverso dalla descrizione", "diversi dalla descrizione", "diverso dalla foto", "diversi dalla foto"),
    "service_or_refund": ("assistenza", "servizio clienti", "rimborso", "rimborsi", "reso", "resi"),
}
# Subjects of questions by word stems, one of each group; and intents with the subjects that decide them, the
# first that fits.
STEMS = {
    "volume": [["volume ordini", "volume degli ordini", "numero di ordini", "numero degli ordini"]], "order value": [["valore medio", "valore degli ordini"]], "rating": [["rating", "valutaz", "punteggio"]],
    "delivery": [["consegna", "ritard", "recapit"]], "negative": [["recension"], ["negativ", "bassa", "basso"]], "rise": [["aument", "increment", "cresc"]], "complaint": [["problem", "lament", "reclam", "motivi"]],
}
ASKED = [
    ("descriptive_only", "order_volume", ["volume"]), ("descriptive_only", "average_order_value", ["order value"]), ("explain_delivery_impact_on_rating", "late_delivery_rate", ["rating", "delivery"]),
    ("explain_negative_review_increase", "negative_review_rate", ["negative", "rise"]), ("explain_rating_drop", "average_rating", ["rating"]),
    ("analyze_low_rating_complaints", "negative_review_rate", ["negative"], ["complaint"]),
]
INTENTS = ("explain_rating_drop", "explain_negative_review_increase", "explain_delivery_impact_on_rating", "analyze_low_rating_complaints", "descriptive_only", "unsupported")


def folded(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def months_in(question: str) -> tuple[str | None, str | None]:
    """First and second month named: ``YYYY-MM`` if any is, else month names with a year; one month is both ends."""
    found = re.findall(r"\b(?:19|20)\d{2}-(?:0[1-9]|1[0-2])\b", question)
    if not found:
        named = re.findall(rf"\b({'|'.join(MONTHS)})\s+((?:19|20)\d{{2}})\b", folded(question))
        found = [f"{year}-{MONTHS.index(month) + 1:02d}" for month, year in named]
    return (found[0], found[min(1, len(found) - 1)]) if found else (None, None)


def category_in(question: str) -> str | None:
    """The category of the longest name in the question."""
    text = folded(question).replace("_", " ")
    hits = [name for name in CATEGORIES if name in text]
    return CATEGORIES[max(hits, key=len)] if hits else None


def theme_in(question: str) -> str | None:
    """The theme of the longest name in the question; of equally long ones the last theme by name."""
    text = folded(question)
    hits = [(len(name), theme) for theme, names in THEME_NAMES.items() for name in names if name in text]
    return max(hits)[1] if hits else None


def intent_of(question: str, theme: str | None = None) -> tuple[str, str]:
    """(intent, metric) of the first line of ``ASKED`` whose subjects the question has; a theme is a complaint."""
    text = folded(question)
    subjects = {name for name, groups in STEMS.items() if all(any(s in text for s in group) for group in groups)} | ({"complaint"} if theme else set())
    for intent, metric, *choices in ASKED:
        if any(set(choice) <= subjects for choice in choices):
            return intent, metric
    return "unsupported", "unknown"


@dataclass(frozen=True)
class Question:
    text: str
    intent: str
    metric: str
    theme: str | None
    filters: Filters


def interpret(text: str, *, intent: str | None = None, metric: str | None = None, theme: str | None = None, category: str | None = None, state: str | None = None, start: str | None = None, end: str | None = None) -> Question:
    """The question with what it asks for; given values beat inferred ones. ValueError for empty or unknown input."""
    if not (text or "").strip():
        raise ValueError("an empty question")
    theme = theme or theme_in(text)
    if theme and theme not in THEME_NAMES:
        raise ValueError(f"unknown theme {theme}")
    guess = intent_of(text, theme)
    first, last = months_in(text)
    if (intent or guess[0]) not in INTENTS:
        raise ValueError(f"unknown intent {intent}")
    filters = Filters(category or category_in(text), state, start or first, end or start or last).validated()
    return Question(text.strip(), intent or guess[0], metric or guess[1], theme, filters)


def insufficient(question: Question, reviews: int, negative_text_reviews: int, rating_change: float | None, negative_change: float | None, mentions: dict[str, int]) -> str | None:
    """Why the evidence cannot answer the question; None if it can. The first reason that holds is given."""
    candidates = {t: n for t, n in mentions.items() if n > 0 and (question.theme in (None, t))}
    impact, drop, rise = (question.intent == i for i in ("explain_delivery_impact_on_rating", "explain_rating_drop", "explain_negative_review_increase"))
    reasons = (
        (question.intent == "unsupported", "unsupported question"),
        (question.intent == "descriptive_only", "a descriptive metric that reviews cannot explain"),
        (reviews == 0, "no reviews under the filters"),
        (negative_text_reviews == 0, "no negative reviews with text under the filters"),
        (impact, "delays and ratings are described, a causal effect is not estimated"),
        (drop and rating_change is None, "a rating drop needs a period with a baseline"),
        (drop and (rating_change or 0) >= 0, "no rating drop is observed"),
        (rise and negative_change is None, "an increase needs a period with a baseline"),
        (rise and (negative_change or 0) <= 0, "no increase of negative reviews is observed"),
        (not candidates, f"no mentions of {question.theme}" if question.theme else "no theme with support"),
    )
    return next((why for holds, why in reasons if holds), None)
