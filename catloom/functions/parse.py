"""Years, amounts and sentences out of free text, as columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from catloom.functions.text import replace_chain, squeeze, strip
from catloom.functions.values import as_col, blank_to_null, case_when

# Verbs and prepositions around a year, in matching order.
PROSE_YEAR_PATTERNS = (
    r"(?i)(?:introduced|released|launched|made|produced|manufactured|marketed|sold|appeared|available)"
    r"\s+(?:in|from|around|circa|ca\.?|c\.?)\s*(\d{4})()",
    r"(?i)(?:from|in)\s+(\d{4})\s*(?:to|[-–])\s*(\d{4})",
    r"(?i)(\d{4})\s*(?:to|[-–])\s*(\d{4})",
)
PLAUSIBLE_YEAR = r"\b(1[89]\d{2}|20[0-2]\d)\b"
# The forms of a year range, of an amount after its label, and of a listed price.
YEAR_SPAN, YEAR = r"(\d{4})\s*[-–]\s*(\d{4})", r"(\d{4})"
LABELLED_AMOUNT = r"[^$]*\$\s*([\d,]+(?:\.\d{2})?)"
AMOUNT_LABELS = ("average", "(?:value|price|worth)")
NO_AMOUNT = r"[^\d.]"
# Markup in a template value and what stays of it, in order; the first two wrap text that is wanted.
WRAPPED_MARKUP = (
    (r"(?i)\{\{nowrap\|([^}]*)\}\}", "$1"),
    (r"(?i)\{\{convert\|([^|]+)\|([^|}]+)[^}]*\}\}", "$1 $2"),
)
VALUE_MARKUP = (
    (r"\{\{[^}]*\}\}", ""),
    (r"\[\[(?:[^|\]]*\|)?([^\]]*)\]\]", "$1"),
    (r"\]\]|\[\[", ""),
    (r"'''|''", ""),
    (r"<[^>]+>", ""),
    (r"&nbsp;", " "),
    (r"&ndash;|&mdash;", "-"),
)
# Every pattern above needs one of these signs.
MARKUP_SIGN = r"[\[\]{}'<&]"


def _int(text: Column) -> Column:
    return blank_to_null(text).try_cast("int")


def _group(c: Column, pattern: str, index: int = 1) -> Column:
    return F.regexp_extract(c, pattern, index)


def years(first: Column, last: Column) -> Column:
    return F.struct(first.alias("year_from"), last.alias("year_to"))


def clean_markup(c: Column | str, keep_wrapped: bool = True) -> Column:
    """Plain text of a wiki markup value. ``keep_wrapped`` keeps what nowrap and convert wrap."""
    steps = (*WRAPPED_MARKUP, *VALUE_MARKUP) if keep_wrapped else VALUE_MARKUP
    value = as_col(c)
    # Most values hold no markup: they skip the replacements.
    return strip(squeeze(F.when(value.rlike(MARKUP_SIGN), replace_chain(value, steps)).otherwise(value)))


def year_range(c: Column | str) -> Column:
    """``1959-1975`` or a single year; missing parts are null."""
    col = as_col(c)
    return years(F.coalesce(_int(_group(col, YEAR_SPAN)), _int(_group(col, YEAR))), _int(_group(col, YEAR_SPAN, 2)))


def leading_year(c: Column | str, low: int = 1820, high: int = 2030) -> Column:
    """Year or range at the start of a text, after an optional ``c.``; only single years are bounded."""
    col = as_col(c)
    head = r"^c?\.?\s*(\d{4})"
    span = head + r"\s*[-–]\s*(\d{4})"
    start = _int(_group(col, span))
    bounded = [
        F.when(year.between(low, high), year)
        for year in (_int(_group(col, head + r"\b")), _int(_group(col, head + r"s\b")))
    ]
    return years(F.coalesce(start, *bounded), _int(_group(col, span, 2)))


def year_in_prose(
    c: Column | str, low: int = 1820, high: int = 2030, window: int | None = None
) -> Column:
    """First plausible phrase year, else the smallest plausible year of the text.

    ``window`` limits the fallback to that many leading characters; by default all text counts.
    """
    col = as_col(c)
    branches_from, branches_to = [], []
    for pattern in PROSE_YEAR_PATTERNS:
        year = _int(_group(col, pattern))
        hit = year.between(low, high)
        branches_from.append((hit, year))
        branches_to.append((hit, _int(_group(col, pattern, 2))))
    scope = col if window is None else F.left(col, F.lit(window))
    mentioned = F.array_min(
        F.transform(F.regexp_extract_all(scope, F.lit(PLAUSIBLE_YEAR)), lambda y: y.cast("int"))
    )
    return years(case_when(branches_from, mentioned), case_when(branches_to))


def price(c: Column | str, low: float = 5, high: float = 50_000) -> Column:
    """Amount of a listing; of a range, the low end; null outside the accepted interval."""
    first = F.split_part(as_col(c), F.lit(" to "), F.lit(1))
    amount = blank_to_null(F.regexp_replace(first, NO_AMOUNT, "")).try_cast("double")
    return F.when(amount.between(low, high), amount)


def labelled_price(c: Column | str) -> Column:
    """Amount after "average", else after "value", "price" or "worth" when positive."""
    col = as_col(c)
    def amount(label: str) -> Column:
        digits = F.replace(_group(col, "(?i)" + label + LABELLED_AMOUNT), F.lit(","), F.lit(""))
        return blank_to_null(digits).try_cast("double")

    average, worth = (amount(label) for label in AMOUNT_LABELS)
    return F.coalesce(average, F.when(worth > 0, worth))


def first_int(c: Column | str, unit: str = "") -> Column:
    """First whole number, optionally only one followed by ``unit``."""
    return _int(_group(as_col(c), r"(\d+)" + (rf"\s*{unit}" if unit else "")))


def lead_sentences(
    c: Column | str,
    asides: Sequence[str] = ("Japanese", "pronounced"),
    max_chars: int = 250,
    max_sentences: int = 2,
    min_chars: int = 15,
    drop_footnotes: bool = False,
    ignore_case: bool = False,
) -> Column:
    """Opening sentences of an article: 1 to ``max_sentences`` while the total stays short.

    The first sentence always counts; the next ones join only while every earlier one did.
    """
    flag = "(?i)" if ignore_case else ""
    col = as_col(c)
    aside = flag + r"\s*\([^)]*(?:" + "|".join(asides) + r")[^)]*\)"
    text = F.when(F.contains(col, F.lit("(")), F.regexp_replace(col, aside, "")).otherwise(col)
    if drop_footnotes:
        text = F.when(F.contains(text, F.lit("[")), F.regexp_replace(text, r"\[\d+\]", "")).otherwise(text)
    # The sentences in play plus the rest of the text, unsplit.
    sentences = F.split(strip(text), r"(?<=[.!?])\s+", max_sentences + 1)
    state = F.struct(F.element_at(sentences, 1).alias("text"), F.lit(True).alias("open"))

    def extend(acc: Column, sentence: Column) -> Column:
        fits = acc["open"] & (F.length(acc["text"]) + F.length(sentence) < max_chars)
        joined = F.concat_ws(" ", acc["text"], sentence)
        return F.struct(F.when(fits, joined).otherwise(acc["text"]).alias("text"), fits.alias("open"))

    lead = F.aggregate(F.slice(sentences, 2, max_sentences - 1), state, extend, lambda acc: acc["text"])
    return F.when(F.length(lead) >= min_chars, strip(lead))


# The two accepted forms of a lead.
SHORT_LEAD = dict(asides=("Japanese", "pronounced"), max_chars=250, max_sentences=2, min_chars=15)
LONG_LEAD = dict(
    asides=("Japanese", "pronounced", "listen", "stylized", "stylised", "IPA"),
    max_chars=350,
    max_sentences=3,
    min_chars=20,
    drop_footnotes=True,
    ignore_case=True,
)
