"""Predicates over urls, texts and states."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from anchorloom.settings import LINKABLE_STATES

# --- Fixed value: a destination that may be linked.
_SAFE_URL = r"(?i)\A(?:https?://|/(?![/\\]))"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def url_pattern(patterns: tuple[str, ...]) -> str | None:
    """One alternation of all patterns: '*' is any run, all else literal; unanchored."""
    used = [p.strip() for p in patterns if p and p.strip()]
    if not used:
        return None
    return "|".join(".*".join(re.escape(x) for x in p.split("*")) for p in used)


def url_excluded(url: Column | str, patterns: tuple[str, ...]) -> Column:
    p = url_pattern(patterns)
    return F.lit(False) if p is None else F.coalesce(_c(url).rlike(f"(?iu){p}"), F.lit(False))


def ingestible(url: Column | str, patterns: tuple[str, ...] = ()) -> Column:
    return F.coalesce(_c(url).rlike(r"(?i)^https?://"), F.lit(False)) & ~url_excluded(url, patterns)


def safe_url(url: Column | str) -> Column:
    """http(s), or a path that browsers cannot take for another host."""
    return F.coalesce(F.translate(_c(url), "\t\n\r", "").rlike(_SAFE_URL), F.lit(False))


def contains_literal(text: Column | str, query: str) -> Column:
    """Letter case ignored; '%', '_' and '\\' are ordinary characters."""
    return F.coalesce(F.contains(F.lower(_c(text)), F.lit(query.lower())), F.lit(False))


def active() -> Column:
    return F.col("enabled") & ~F.col("removed_from_source")


def linkable(state: Column | str = "state") -> Column:
    return _c(state).isin(*LINKABLE_STATES)


def page_state(name: str | None) -> Column:
    """live, disabled (whether removed or not) or removed; anything else keeps all rows."""
    return {"live": active(), "disabled": ~F.col("enabled"), "removed": F.col("removed_from_source")}.get(name or "", F.lit(True))
