"""Secrets in texts: which values of an environment count as secret, where they leak, and their redaction."""

from __future__ import annotations

import re
from collections.abc import Mapping
from urllib.parse import urlsplit

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Parts of names of settings that hold a secret, the least length of one, and what stands in its place.
MARKERS = ("API_KEY", "TOKEN", "SECRET", "PASSWORD", "DATABASE_URL")
LEAST, REDACTED = 4, "[REDACTED]"


def secret_values(env: Mapping[str, str], also: tuple[str, ...] = ()) -> tuple[str, ...]:
    """Secret values of an environment (and of the settings named in `also`), and the passwords inside those that are URLs."""
    held = [v.strip() for k, v in env.items() if k in also or any(m in k.upper() for m in MARKERS)]
    out = []
    for value in held:
        if len(value) >= LEAST:
            out.append(value)
            try:
                out.append(urlsplit(value).password or "")
            except ValueError:
                continue
    return tuple(dict.fromkeys(v for v in out if v))


def _pattern(secrets: tuple[str, ...]) -> str:
    return "|".join(re.escape(s) for s in sorted(secrets, key=len, reverse=True))


def redact(text: Column, secrets: tuple[str, ...]) -> Column:
    """The text without secrets, in one pass; longer ones first, so that no part of one stays."""
    return F.regexp_replace(text, _pattern(secrets), F.lit(REDACTED)) if secrets else text


def leaks(rows: DataFrame, key: str, columns: tuple[str, ...], secrets: tuple[str, ...]) -> DataFrame:
    """key, column: where a secret stands in plain text."""
    if not secrets:
        return rows.select(key, F.lit("").alias("column")).where("false")
    found = F.array_compact(F.array(*[F.when(F.col(c).cast("string").rlike(_pattern(secrets)), F.lit(c)) for c in columns]))
    return rows.select(key, F.explode(found).alias("column"))
