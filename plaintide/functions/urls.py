"""Attributes read from product URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from .vocabulary import PLATFORM_HOSTS, PRODUCT_ID_PATTERN


def platform_of(url: Column, hosts: Sequence[tuple[str, str]] = PLATFORM_HOSTS) -> Column:
    """Platform by substring of the host, first rule wins, else ``unknown``."""
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    found = F.coalesce(
        *[F.when(host.contains(part), F.lit(platform)) for part, platform in hosts]
    )
    return F.coalesce(found, F.lit("unknown"))


def product_id_of(url: Column, pattern: str = PRODUCT_ID_PATTERN) -> Column:
    """First group of ``pattern``; null without a match."""
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))
