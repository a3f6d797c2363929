"""Name, path and URL scalars. Every function takes and returns columns and stays in the JVM."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from catloom.functions.values import as_col, bind, blank_to_null, has_text
from catloom.vocabulary import (
    BRAND_SYNONYMS,
    IMAGE_EXTENSIONS,
    MARKETING_TERMS,
    MODEL_SUFFIXES,
)


def strip(c: Column | str) -> Column:
    return F.btrim(as_col(c), F.lit(" \t\n\r\x0b\f"))


def squeeze(c: Column | str) -> Column:
    """Every run of blanks becomes one blank."""
    return F.regexp_replace(as_col(c), r"\s+", " ")


def replace_chain(c: Column | str, steps: Iterable[tuple[str, str]]) -> Column:
    return reduce(lambda col, step: F.regexp_replace(col, step[0], step[1]), steps, as_col(c))


def normalize_name(c: Column | str) -> Column:
    """Lower case, trimmed, single blanks; trademark signs go last, so a blank before one stays."""
    return F.translate(squeeze(strip(F.lower(as_col(c)))), "™®©", "")


def match_key_spaced(c: Column | str) -> Column:
    return strip(F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]+", " "))


def match_key_compact(c: Column | str) -> Column:
    return F.regexp_replace(F.lower(as_col(c)), r"[^a-z0-9]", "")


def _latin_folding() -> tuple[str, str]:
    """Single-letter Latin decompositions, derived from the Unicode database."""
    pairs = []
    for code in range(0x00C0, 0x0250):
        base = "".join(
            ch for ch in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(ch)
        )
        if len(base) == 1 and base.isascii():
            pairs.append((chr(code), base))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_ACCENTED, _PLAIN = _latin_folding()


# Loose combining marks have no counterpart in the replacement, so translate deletes them.
_MARKS = "".join(chr(code) for code in range(0x0300, 0x0370))


def strip_accents(c: Column | str) -> Column:
    """Latin letters lose their marks and loose combining marks vanish, in one translate."""
    col = as_col(c)
    plain = F.octet_length(col) == F.length(col)
    return F.when(plain, col).otherwise(F.translate(col, _ACCENTED + _MARKS, _PLAIN))


@F.udf(T.StringType(), useArrow=False)
def fold_unicode(value: str | None) -> str | None:
    """Full compatibility decomposition without marks, for scripts ``strip_accents`` leaves alone.

    Rows travel a hundred at a time, so a worker's memory does not depend on how many texts fill an Arrow batch.
    """
    if value is None or value.isascii():
        return value
    return "".join(ch for ch in unicodedata.normalize("NFKD", value) if not unicodedata.combining(ch))


def ascii_fold(c: Column | str) -> Column:
    """Fold Latin letters, then drop what is still not ASCII."""
    return F.regexp_replace(strip_accents(c), r"[^\x00-\x7f]", "")


def safe_path(c: Column | str) -> Column:
    underscored = replace_chain(c, [(r'[<>:"/\\|?*]', "_"), (r"[\s_]+", "_"), (r"^[_.]+|[_.]+$", "")])
    return F.coalesce(blank_to_null(F.left(underscored, F.lit(200))), F.lit("unknown"))


def slug(c: Column | str) -> Column:
    return replace_chain(F.lower(as_col(c)), [(r"[^a-z0-9]+", "-"), (r"^-+|-+$", "")])


def starts_with_ci(text: Column | str, prefix: Column | str) -> Column:
    return F.startswith(F.lower(as_col(text)), F.lower(as_col(prefix)))


def display_name(brand: Column | str, name: Column | str) -> Column:
    """Put the brand in front unless the name already begins with it."""
    return F.when(
        has_text(brand) & ~starts_with_ci(name, brand), F.concat_ws(" ", as_col(brand), as_col(name))
    ).otherwise(as_col(name))


def short_id(entity_id: Column | str, name: Column | str, width: int = 8) -> Column:
    return F.left(F.coalesce(blank_to_null(entity_id), as_col(name)), F.lit(width))


def web_path(c: Column | str, root: str = "data/images/") -> Column:
    return F.regexp_replace(as_col(c), "^" + re.escape(root), "")


def thumb_url(c: Column | str, leaf: str = "thumb.webp") -> Column:
    return F.regexp_replace(as_col(c), r"/[^/]+$", "/" + leaf)


def extension(url: Column | str, allowed: Sequence[str] = IMAGE_EXTENSIONS, default: str = "jpg") -> Column:
    bare = F.regexp_replace(as_col(url), r"[?#].*$", "")
    found = F.lower(F.regexp_extract(bare, r"\.([0-9A-Za-z_]{2,5})$", 1))
    return F.when(found.isin(list(allowed)), found).otherwise(F.lit(default))


def name_from_slug(c: Column | str) -> Column:
    """``F-301`` keeps its hyphen, every other hyphen turns into a blank."""
    return replace_chain(
        F.translate(as_col(c), "-", " "),
        [(r"\b([A-Z]{1,3}) (\d)", "$1-$2"), (r"\b([a-z]) (\d)", "$1-$2")],
    )


def strip_marketing_terms(c: Column | str, rules: Sequence[tuple[str, str]] = MARKETING_TERMS) -> Column:
    return strip(squeeze(replace_chain(strip(c), rules)))


def build_query(brand: Column | str, name: Column | str, min_length: int = 5) -> Column:
    """Search text for an item; null when too short to be useful."""
    plain = F.regexp_replace(display_name(brand, name), r"\s*\([^)\n]*\)", "")
    text = strip(squeeze(ascii_fold(plain)))
    return F.when(F.length(text) >= min_length, text)


def ordered_distinct(values: Column, key=lambda x: x) -> Column:
    """Keep the first element of each key, in the original order; a null key is a key like any other.

    Elements are sorted by (key, place), those that differ from their neighbour are first of their key, and a second sort
    restores the order: n log n steps, so arrays may be long.
    """
    placed = F.array_sort(F.transform(values, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("v"))))

    def firsts(ordered: Column) -> Column:
        return F.filter(ordered, lambda x, i: (i == 0) | ~x["k"].eqNullSafe(F.get(ordered, i - 1)["k"]))

    restored = F.array_sort(F.transform(bind(placed, firsts), lambda x: F.struct(x["i"].alias("i"), x["v"].alias("v"))))
    return F.transform(restored, lambda x: x["v"])


def query_variants(
    brand: Column | str,
    name: Column | str,
    synonyms: Sequence[tuple[Sequence[str], Sequence[str]]] = BRAND_SYNONYMS,
) -> Column:
    """Alternative search texts of an item, most specific first."""
    brand = as_col(brand)
    base = strip(F.regexp_replace(as_col(name), r"\s*\([^)]*\)", ""))
    first_word = F.split_part(brand, F.lit(" "), F.lit(1))

    def without(prefix: Column) -> Column:
        return strip(F.substr(base, F.length(prefix) + 1))

    model = (
        F.when(~has_text(brand), base)
        .when(starts_with_ci(base, brand), without(brand))
        .when(starts_with_ci(base, first_word), without(first_word))
        .otherwise(base)
    )
    hyphenated = F.regexp_replace(model, r"(\D)\s+(\d)", "$1-$2")
    short = replace_chain(model, MODEL_SUFFIXES)
    branded = lambda text: F.when(has_text(brand), F.concat_ws(" ", brand, text))
    candidates = [
        branded(model),
        F.when(hyphenated != model, branded(hyphenated)),
        F.when(short != model, branded(short)),
    ]
    for members, spellings in synonyms:
        candidates += [
            F.when(brand.isin(list(members)), F.concat(F.lit(spelling + " "), model))
            for spelling in spellings
        ]
    candidates.append(base)
    return ordered_distinct(F.array_compact(F.array(*candidates)), lambda q: strip(F.lower(q)))


def split_list(c: Column | str) -> Column:
    parts = F.transform(F.split(as_col(c), "[,;]"), lambda part: F.trim(part))
    return F.filter(parts, lambda part: part != "")


def url_title(c: Column | str, host: str = "wiki.example.org") -> Column:
    """Page title in an article URL, decoded, without its fragment."""
    raw = F.regexp_extract(as_col(c), re.escape(host) + r"/wiki/([^#]+)", 1)
    return F.try_url_decode(F.replace(blank_to_null(raw), F.lit("+"), F.lit("%2B")))


def title_url(c: Column | str, base: str = "https://wiki.example.org/wiki/") -> Column:
    return F.concat(F.lit(base), F.replace(as_col(c), F.lit(" "), F.lit("_")))


def file_name(c: Column | str) -> Column:
    """File title in a media page URL."""
    raw = F.regexp_extract(as_col(c), r"/wiki/File:(.+)$", 1)
    return F.try_url_decode(F.replace(blank_to_null(raw), F.lit("+"), F.lit("%2B")))


def upscale_url(c: Column | str, small: str = "sqtmn", large: str = "z") -> Column:
    """Ask the photo host for a larger rendition when the URL names a thumbnail."""
    return F.regexp_replace(as_col(c), rf"(?i)_[{small}]\.(?:jpg|jpeg|png)$", f"_{large}.jpg")


def tokens(c: Column | str) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(as_col(c)), F.lit("([a-z0-9]+)")))
