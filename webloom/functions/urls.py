"""Column functions over links. Only joining a relative link to its page leaves the JVM, in Arrow batches."""

from __future__ import annotations

from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as lex


def _join(base: str | None, href: str | None) -> str | None:
    try:
        return urljoin(base or "", href) if href is not None else None
    except ValueError:
        return None


def _joined(base: pd.Series, href: pd.Series) -> pd.Series:
    return pd.Series([_join(b, h) for b, h in zip(base, href)], dtype=object)


def url_join(base: Column, href: Column) -> Column:
    """The link as seen from its page; null where it is malformed."""
    return F.pandas_udf(_joined, "string")(base, href)


def part(url: Column, name: str) -> Column:
    """HOST, AUTHORITY, PATH, ... or null where the link is malformed."""
    return F.try_parse_url(url, F.lit(name))


def normalized(url: Column) -> Column:
    """Without fragment, with http where no scheme is given."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(bare.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), bare).otherwise(F.concat(F.lit("http://"), F.regexp_replace(bare, "^//", "")))


def is_social(url: Column) -> Column:
    return F.coalesce(F.lower(url).rlike("|".join(lex.SOCIAL)), F.lit(False))


def social_platform(url: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(url).rlike(p), F.lit(name)) for p, name in lex.SOCIAL.items()], F.lit("unknown"))
