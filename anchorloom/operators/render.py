"""Text nodes of rendered posts, and anchors in plain text and HTML."""

from __future__ import annotations

from html import escape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: elements whose texts are never linked.
SKIP_TAGS = frozenset("a code pre iframe script style svg math kbd samp var textarea".split())
SKIP_CLASSES = frozenset("onebox lightbox-wrapper meta".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Nodes(HTMLParser):
    """Pieces of the source: (is a linkable text node, source, text)."""

    def __init__(self, skip_quotes: bool):
        super().__init__(convert_charrefs=False)
        self.skip_quotes, self.stack, self.pieces = skip_quotes, [], []

    def _skips(self, tag, attrs):
        classes = set((dict(attrs).get("class") or "").split())
        return tag in SKIP_TAGS or bool(classes & SKIP_CLASSES) or self.skip_quotes and (tag == "blockquote" or tag == "aside" and "quote" in classes)

    def _markup(self, source):
        self.pieces.append([False, source, ""])

    def handle_starttag(self, tag, attrs):
        if tag not in VOID:
            self.stack.append((tag, self._skips(tag, attrs)))
        self._markup(self.get_starttag_text())

    def handle_startendtag(self, tag, attrs):
        self._markup(self.get_starttag_text())

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break
        self._markup(f"</{tag}>")

    def _text(self, source, text):
        ok = not any(skip for _, skip in self.stack)
        if self.pieces and self.pieces[-1][2] and self.pieces[-1][0] == ok:
            self.pieces[-1][1] += source
            self.pieces[-1][2] += text
        else:
            self.pieces.append([ok, source, text])

    def handle_data(self, data):
        self._text(data, data)

    def handle_entityref(self, name):
        from html import unescape

        self._text(f"&{name};", unescape(f"&{name};"))

    def handle_charref(self, name):
        from html import unescape

        self._text(f"&#{name};", unescape(f"&#{name};"))

    def handle_comment(self, data):
        self._markup(f"<!--{data}-->")

    def handle_decl(self, decl):
        self._markup(f"<!{decl}>")


def html_pieces(html: str | None, skip_quotes: bool = True) -> list[list]:
    p = _Nodes(skip_quotes)
    p.feed(html or "")
    p.close()
    return p.pieces


def text_nodes(posts: DataFrame, key: str, html: str, skip_quotes: bool = True) -> DataFrame:
    """(key, node_index, text) of linkable text nodes in document order; null HTML gives none."""

    @F.pandas_udf("array<string>")
    def nodes(col: pd.Series) -> pd.Series:
        return col.map(lambda h: [t for ok, _, t in html_pieces(h, skip_quotes) if ok and t])

    return posts.select(F.col(key), F.posexplode(nodes(F.col(html))).alias("node_index", "text"))


def plain_nodes(posts: DataFrame, key: str, text: str) -> DataFrame:
    """One node per post: its whole text."""
    return posts.select(F.col(key), F.lit(0).alias("node_index"), F.col(text).alias("text"))


def anchor_open(css: str) -> Column:
    """The opening tag of a link struct (url, type, phrase, entry_id)."""
    attr = lambda c: F.replace(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;")), F.lit("<"), F.lit("&lt;"))
    return lambda m: F.concat(
        F.lit('<a href="'), attr(m["url"]), F.lit(f'" class="{css} {css}-'), m["type"], F.lit(f'" data-{css}="true" data-{css}-type="'), m["type"], F.lit(f'" data-{css}-term="'), attr(m["phrase"]), F.lit('"'),
        F.coalesce(F.concat(F.lit(f' data-{css}-id="'), m["entry_id"].cast("string"), F.lit('"')), F.lit("")), F.lit(">"),
    )


def render_text(nodes: DataFrame, links: DataFrame, keys: list[str], css: str = "autolink") -> DataFrame:
    """(*keys, node_index, rendered, n_links): texts with anchors around accepted links, the
    original characters kept; nodes without a link as they are."""
    per = links.groupBy(*keys, "node_index").agg(F.array_sort(F.collect_list(F.struct("start", "length", "url", "type", "phrase", "entry_id"))).alias("links"))
    d = nodes.join(per, [*keys, "node_index"], "left")
    tag = anchor_open(css)
    done = F.aggregate(
        F.coalesce("links", F.array().cast("array<struct<start:int,length:int,url:string,type:string,phrase:string,entry_id:bigint>>")),
        F.struct(F.lit("").alias("out"), F.lit(0).alias("at")),
        lambda acc, m: F.struct(
            F.concat(acc["out"], F.substring("text", acc["at"] + 1, m["start"] - acc["at"]), tag(m), F.substring("text", m["start"] + 1, m["length"]), F.lit("</a>")).alias("out"),
            (m["start"] + m["length"]).alias("at"),
        ),
        lambda acc: F.concat(acc["out"], F.substring("text", acc["at"] + 1, F.length("text"))),
    )
    return d.select(*keys, "node_index", done.alias("rendered"), F.coalesce(F.size("links"), F.lit(0)).alias("n_links"))


def rewrite_html(html: str, links: list[dict], css: str, skip_quotes: bool = True) -> str:
    """HTML with anchors in its text nodes; everything else as in the source."""
    by_node: dict[int, list[dict]] = {}
    for m in links:
        by_node.setdefault(m["node_index"], []).append(m)
    out, k = [], 0
    for ok, source, text in html_pieces(html, skip_quotes):
        if not (ok and text):
            out.append(source)
            continue
        ms = sorted(by_node.get(k, ()), key=lambda m: m["start"])
        k += 1
        if not ms:
            out.append(source)
            continue
        at = 0
        for m in ms:
            ident = f' data-{css}-id="{m["entry_id"]}"' if m["entry_id"] is not None else ""
            out.append(escape(text[at : m["start"]], quote=False))
            at = m["start"] + m["length"]
            out.append(f'<a href="{escape(m["url"])}" class="{css} {css}-{m["type"]}" data-{css}="true" data-{css}-type="{m["type"]}" data-{css}-term="{escape(m["phrase"])}"{ident}>{escape(text[m["start"] : at], quote=False)}</a>')
        out.append(escape(text[at:], quote=False))
    return "".join(out)


def render_html(posts: DataFrame, links: DataFrame, key: str, html: str, css: str = "autolink", skip_quotes: bool = True) -> DataFrame:
    """(key, rendered, n_links). Null HTML stays null."""
    per = links.groupBy(key).agg(F.collect_list(F.struct("node_index", "start", "length", "url", "type", "phrase", "entry_id")).alias("links"))
    d = posts.select(key, F.col(html).alias("html")).join(per, key, "left")

    @F.pandas_udf("string")
    def rewrite(h: pd.Series, ms: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else x if m is None or len(m) == 0 else rewrite_html(x, list(m), css, skip_quotes) for x, m in zip(h, ms, strict=True)], dtype=object)

    return d.select(key, rewrite("html", "links").alias("rendered"), F.coalesce(F.size("links"), F.lit(0)).alias("n_links"))
