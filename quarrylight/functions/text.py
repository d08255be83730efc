"""Text, name and URL expressions. Everything here is a Column expression that stays in whole-stage code generation."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

UNKNOWN = "unknown"
#: White space as Python's str.strip() sees it.
SPACES = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SPACE = f"[{SPACES}]"
# Tokens and phrases that end a company's name without naming it.
LEGAL_SUFFIXES = ("brasil", "company", "inc", "ltda", "s a", "sa", "startup", "startups", "tecnologia")
# Domains under which a company registers one level deeper.
SECOND_LEVEL = ("com", "net", "org", "gov")
# Tokens that say nothing about a need.
STOP_TOKENS = ("need", "needs", "support", "supported", "supporting", "supports", "workflow", "workflows")


@lru_cache(1)
def _folds() -> tuple[str, str]:
    """Characters of the basic plane whose compatibility form, without marks, is one other character, and that form; then the
    marks, which have none (translate() drops what has no counterpart)."""
    pairs, marks = [], []
    for code in range(0x80, 0x10000):
        if 0xD800 <= code < 0xE000:
            continue
        bare = "".join(c for c in unicodedata.normalize("NFKD", chr(code)) if not unicodedata.combining(c))
        if len(bare) == 1 and bare != chr(code):
            pairs.append((chr(code), bare))
        elif not bare:
            marks.append(chr(code))
    return "".join([a for a, _ in pairs] + marks), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Accents off, lower case, stripped. Ligatures and fractions (more than one character) stay as they are."""
    return strip(F.lower(F.translate(text, *_folds())))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACES))


def collapse(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"{SPACE}+", " "))


def startup_name(name: Column) -> Column:
    """The part of a company's name that tells it from others."""
    plain = collapse(F.regexp_replace(fold(name), r"(?U)[^\w\s-]", " "))
    ending = "|".join(LEGAL_SUFFIXES)
    return known(F.regexp_replace(plain, rf"(?:(?:^| )(?:{ending}))+$", ""))


def known(text: Column) -> Column:
    """The text, or the sentinel for what is not known."""
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(UNKNOWN))


_SCHEME = "[A-Za-z][A-Za-z0-9+.-]*:"
#: "host/path" is taken as "https://host/path"; "scheme:rest" without "//" has no host.
_HOST = rf"(?i)^\s*(?!{_SCHEME}(?!//))(?:(?:{_SCHEME})?//)?(?:www\.)?([^/?#\s]*)"
_PATH = rf"(?s)^\s*(?:{_SCHEME}(?://[^/?#]*)?|//[^/?#]*|[^/?#]*)([^?#;]*?)\s*(?:[?#;].*)?$"


def url_scheme(url: Column) -> Column:
    found = F.regexp_extract(url, r"^\s*([A-Za-z][A-Za-z0-9+.-]*):", 1)
    return F.coalesce(F.nullif(F.lower(found), F.lit("")), F.lit("https"))


def url_netloc(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, _HOST, 1))


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, _PATH, 1)


def is_known_url(url: Column) -> Column:
    return url.isNotNull() & (url != UNKNOWN) & (strip(url) != "")


def normalize_url(url: Column) -> Column:
    """scheme://host/path without www, query, parameters, fragment and last slash."""
    whole = F.concat(url_scheme(url), F.lit("://"), url_netloc(url), F.regexp_replace(url_path(url), "/+$", ""))
    return F.when(is_known_url(url), whole).otherwise(F.lit(UNKNOWN))


def domain(url: Column) -> Column:
    """The last two labels of the host, or three under a country's second level."""
    ending = rf"([^.]+\.(?:{'|'.join(SECOND_LEVEL)})\.br|[^.]+\.[^.]+|[^.]+)$"
    return F.when(is_known_url(url), known(F.regexp_extract(url_netloc(url), ending, 1))).otherwise(F.lit(UNKNOWN))


def origin(url: Column) -> Column:
    host = url_netloc(url)
    return F.when(is_known_url(url) & (host != ""), F.concat(url_scheme(url), F.lit("://"), host)).otherwise(F.lit(UNKNOWN))


def has_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term is a substring (not a token) of the text."""
    return text.rlike("|".join(re.escape(t) for t in terms)) if terms else F.lit(False)


def tokens(text: Column, stop: tuple[str, ...] = STOP_TOKENS) -> Column:
    """Folded tokens of a-z and 0-9, without stop tokens."""
    found = F.regexp_extract_all(fold(text), F.lit("[a-z0-9]+"), 0)
    return F.filter(found, lambda t: ~t.isin(*stop)) if stop else found


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-|-$", "")


def snippet(text: Column, value: Column, window: int = 160, folded: Column | None = None) -> Column:
    """`window` characters around the value's place in the folded text, else the first ones."""
    at = F.instr(fold(text) if folded is None else folded, fold(value))
    start = F.greatest(at - 1 - window // 2, F.lit(0))
    end = F.least(at - 1 + F.char_length(value) + window // 2, F.char_length(text))
    near = F.substring(text, start + 1, end - start)
    return F.when(text == UNKNOWN, UNKNOWN).when(at > 0, strip(near)).otherwise(strip(F.substring(text, 1, window)))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0.0 where b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.nullif(b, F.lit(0)))
