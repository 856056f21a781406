"""Columns over urls and white space."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space in the Unicode sense, as a Java character class without brackets.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without surrounding white space; ``trim`` removes U+0020 only."""
    return F.regexp_replace(_c(c), rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze(c: Column | str) -> Column:
    """Trimmed, each run of white space as one space."""
    return F.regexp_replace(strip(c), rf"[{SPACE}]+", " ")


def page_url(c: Column | str) -> Column:
    """A page url without surrounding white space and trailing slashes."""
    return F.regexp_replace(_c(c), rf"^[{SPACE}]+|[{SPACE}/]+\z", "")


def resource_key(c: Column | str) -> Column:
    """A url as a key: trimmed, no trailing slashes, scheme and host in lower case.

    The path keeps its letter case. Blank gives null.
    """
    u = page_url(c)
    head = F.regexp_extract(u, r"^([A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*)", 1)
    key = F.concat(F.lower(head), F.substr(u, F.length(head) + 1))
    return F.nullif(key, F.lit(""))
