"""Settings of a linking catalog. List settings are '|'-separated as text."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Settings:
    enabled: bool = False
    max_links_per_destination: int = 1  # 0: no limit
    max_links_per_post: int = 0  # 0: no limit
    skip_quotes: bool = True
    include_private: bool = False
    excluded_categories: tuple[int, ...] = ()
    enabled_types: tuple[str, ...] = ()  # none: all
    type_priority: tuple[str, ...] = ("manual",)
    min_phrase_length: int = 5
    min_phrase_words: int = 2
    generate_plurals: bool = True
    title_suffixes: tuple[str, ...] = ()
    excluded_url_patterns: tuple[str, ...] = ()
    excluded_terms: tuple[str, ...] = ()
    auto_import_new_sitemaps: bool = False
    sync_enabled: bool = False
    host_rewrites: tuple[str, ...] = ()
    auto_rebake_on_changes: bool = False
    auto_rebake_max_phrases: int = 50
    auto_rebake_max_posts: int = 500
    max_rebakes_per_job_run: int = 200
    anchor_class: str = "autolink"  # class and data attribute prefix of rendered anchors

    def rule_key(self) -> tuple:
        """A ruleset must be compiled anew when one of these changes; others affect generation only."""
        return (self.enabled_types, self.type_priority, self.excluded_terms, self.excluded_url_patterns, getattr(self, "mappings", ()))

    with_ = replace


def split_setting(value: str | None, strip: bool = True) -> tuple[str, ...]:
    """Elements of a list setting. Sources, mappings, suffixes and url patterns are stripped;
    excluded terms, enabled types and type priorities are not."""
    parts = [p.strip() if strip else p for p in (value or "").split("|")]
    return tuple(p for p in parts if p)


def parse_mappings(value: str | None) -> list[tuple[str, str, str]]:
    """(phrase, url, type) of rows 'phrase,url,type'; type defaults to manual; rows without
    phrase or url are skipped; anything after a third comma is dropped."""
    out = []
    for row in split_setting(value):
        f = [x.strip() for x in row.split(",")] + ["", "", ""]
        if f[0] and f[1]:
            out.append((f[0], f[1], f[2] or "manual"))
    return out


def parse_sources(value: str | None) -> list[tuple[str, str]]:
    """(url, type) of rows 'url,type'; type defaults to content."""
    out = []
    for row in split_setting(value):
        f = [x.strip() for x in row.split(",")] + [""]
        if f[0]:
            out.append((f[0], f[1] or "content"))
    return out


def parse_rewrites(rows: tuple[str, ...]) -> dict[str, str]:
    """public host (lower case) -> target 'host', 'host:port' or 'scheme://host:port'; bad rows are skipped."""
    out = {}
    for row in rows:
        public, eq, target = row.partition("=")
        if eq and public.strip() and target.strip():
            out[public.strip().lower()] = target.strip()
    return out


#: States and origins of a phrase, kinds and states of a sitemap.
TERM_STATES = ("auto_active", "pending_review", "approved", "disabled")
LINKABLE_STATES = ("auto_active", "approved")
ORIGINS = ("generated", "manual")
SITEMAP_STATUSES = ("pending", "enabled", "ignored")


def check_state(value: str) -> str:
    if value not in TERM_STATES:
        raise ValueError(f"unknown state: {value}")
    return value
