"""Queries from rules to rendered links, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from anchorloom.functions.filters import linkable
from anchorloom.operators import render, rules
from anchorloom.operators.posts import excluded_categories as excluded_category_ids
from anchorloom.operators.posts import linkable_posts as linkable_posts_op
from anchorloom.operators.resolve import resolve
from anchorloom.operators.scan import scan
from anchorloom.plans.fixture import MAPPINGS, SETTINGS, VIEWS, categories
from anchorloom.plans.texts import _EXCLUDED, _SAFE, NORM
from anchorloom.sources.catalog import Catalog

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = lambda spark, d: f(Catalog(spark, d))
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def rule_inputs(c: Catalog) -> tuple[DataFrame, DataFrame]:
    return c.term_rows("entry_id", "normalized_phrase", "state", "origin"), c.entry_rows("url", "content_type", "priority", "enabled", "removed_from_source")


def db_rules(c: Catalog) -> DataFrame:
    return rules.database_rules(*rule_inputs(c), SETTINGS)


def every_rule(c: Catalog) -> DataFrame:
    return rules.all_rules(c.spark, *rule_inputs(c), SETTINGS, MAPPINGS)


def ruleset(c: Catalog) -> DataFrame:
    return rules.compile_rules(every_rule(c))


def text_posts(c: Catalog) -> DataFrame:
    """One text node per post that may be linked."""
    posts = c.post_rows("raw", "post_type", "topic_id", "category_id", "private")
    return render.plain_nodes(linkable_posts_op(posts, categories(c), SETTINGS), "id", "raw").withColumnRenamed("id", "doc_id")


RULES = VIEWS + f""",
db AS (SELECT t.normalized_phrase AS phrase, e.url, e.content_type AS type, coalesce(e.priority, CASE WHEN t.origin = 'manual' THEN -1 END, CASE e.content_type WHEN 'manual' THEN 0 WHEN 'docs' THEN 1 WHEN 'wiki' THEN 2 ELSE 3 END)::INTEGER AS priority,
    e.id AS entry_id, t.id AS seq FROM t JOIN e ON e.id = t.entry_id
  WHERE t.state IN ('auto_active', 'approved') AND e.enabled AND NOT e.removed_from_source AND (t.origin = 'manual' OR t.normalized_phrase NOT IN ('aguja de vela', 'fairlead', 'bow saw')) AND NOT {_EXCLUDED.format("e.url")}),
maps AS (SELECT {NORM.format("a.phrase")} AS phrase, a.url, a.type, -2 AS priority, NULL::BIGINT AS entry_id, a.seq FROM (VALUES {", ".join(f"('{p}', '{u}', '{t}', {i - 2_000_000_000})" for i, (p, u, t) in enumerate(MAPPINGS))}) AS a(phrase, url, type, seq)),
ar AS (SELECT * FROM maps UNION ALL SELECT * FROM db),
rs AS (SELECT * FROM ar WHERE phrase <> '' AND {_SAFE.format("url")} QUALIFY row_number() OVER (PARTITION BY phrase ORDER BY coalesce(priority, 0), url, seq) = 1)
"""
#: Posts that may be linked.
POSTS = RULES + """,
cat AS (SELECT DISTINCT category_id::BIGINT AS id FROM p WHERE category_id IS NOT NULL),
anc AS (SELECT id AS leaf, id AS node, 1 AS depth FROM cat UNION ALL SELECT a.leaf, a.node // 2, a.depth + 1 FROM anc a JOIN cat ON cat.id = a.node WHERE a.depth < 5 AND a.node // 2 > 0),
bad AS (SELECT DISTINCT leaf FROM anc WHERE node IN (3, 7)),
lp AS (SELECT id, raw, cooked FROM p WHERE regexp_matches(raw, '\\S') AND post_type = 'regular' AND topic_id IS NOT NULL AND NOT private AND (category_id IS NULL OR category_id NOT IN (SELECT leaf FROM bad)))
""".replace("\\\\", "\\")
_B = r"""[ \t\n\r:.;,!?…()\[\]{}"„“”«»]"""


def hits_sql(texts: str, rules: str) -> str:
    return f"""
, nt AS (SELECT doc_id, {NORM.format("text")} AS norm FROM ({texts}) WHERE length(text) >= 2),
pair AS (SELECT doc_id, norm, phrase, unnest(list_filter(range(1, length(norm) - length(phrase) + 2), lambda i: norm[i:i + length(phrase) - 1] = phrase)) AS i FROM nt JOIN (SELECT phrase FROM {rules}) ON contains(norm, phrase)),
hits AS (SELECT doc_id, (i - 1)::INTEGER AS start, length(phrase)::INTEGER AS length, phrase FROM pair
  WHERE (i = 1 OR regexp_matches(norm[i - 1:i - 1], '{_B}')) AND (i + length(phrase) > length(norm) OR regexp_matches(norm[i + length(phrase):i + length(phrase)], '{_B}')))
"""


SCANNED = POSTS + hits_sql("SELECT id AS doc_id, raw AS text FROM lp", "rs")


def resolved_sql(per: int, total: int, scanned: str = SCANNED) -> str:
    return scanned + f""",
cs AS (SELECT doc_id, list(struct_pack(l := -length, pr := coalesce(priority, 0), s := start, f := start + length, phrase := phrase, url := url) ORDER BY -length, coalesce(priority, 0), start) AS cands FROM hits JOIN rs USING (phrase) GROUP BY doc_id),
go AS (SELECT doc_id, cands, 0::BIGINT AS k, []::STRUCT(s INTEGER, f INTEGER)[] AS claimed, []::STRUCT(s INTEGER, phrase VARCHAR, url VARCHAR)[] AS acc FROM cs
  UNION ALL
  SELECT doc_id, cands, k + 1, CASE WHEN free THEN list_append(claimed, struct_pack(s := x.s, f := x.f)) ELSE claimed END,
    CASE WHEN free AND ({total} = 0 OR len(acc) < {total}) AND ({per} = 0 OR len(list_filter(acc, lambda z: z.url = x.url)) < {per}) THEN list_append(acc, struct_pack(s := x.s, phrase := x.phrase, url := x.url)) ELSE acc END
  FROM (SELECT *, cands[k + 1] AS x, len(list_filter(claimed, lambda z: z.s < cands[k + 1].f AND z.f > cands[k + 1].s)) = 0 AS free FROM go WHERE k < len(cands))),
links AS (SELECT doc_id, a.s AS start, length(a.phrase)::INTEGER AS length, a.phrase AS phrase, a.url AS url FROM (SELECT doc_id, unnest(acc) AS a FROM go WHERE k = len(cands)))
"""


@query(POSTS + "SELECT id FROM lp")
def linkable_posts(c: Catalog) -> DataFrame:
    return linkable_posts_op(c.posts, categories(c), SETTINGS).select("id")


@query(POSTS + "SELECT leaf AS id FROM bad")
def excluded_categories(c: Catalog) -> DataFrame:
    return excluded_category_ids(categories(c), SETTINGS.excluded_categories)


@query(RULES + "SELECT phrase, url, type, priority, entry_id FROM db")
def database_rules(c: Catalog) -> DataFrame:
    return db_rules(c).drop("seq")


@query(RULES + "SELECT t.id, coalesce(e.priority, CASE WHEN t.origin = 'manual' THEN -1 END, CASE e.content_type WHEN 'manual' THEN 0 WHEN 'docs' THEN 1 WHEN 'wiki' THEN 2 ELSE 3 END)::INTEGER AS rank FROM t JOIN e ON e.id = t.entry_id")
def rule_priority(c: Catalog) -> DataFrame:
    e = c.entries.select(F.col("id").alias("entry_id"), "priority", "content_type")
    return c.terms.select("id", "entry_id", "origin").join(e, "entry_id").select("id", rules.rule_priority(SETTINGS).alias("rank"))


@query(RULES + "SELECT phrase, url, type, priority, entry_id FROM rs")
def compile_rules(c: Catalog) -> DataFrame:
    return ruleset(c).drop("seq")


@query(RULES + f"SELECT DISTINCT phrase, entry_id FROM db WHERE {_SAFE.format('url')}")
def linking_pairs(c: Catalog) -> DataFrame:
    return rules.linking_pairs(db_rules(c))


@query(RULES + f"SELECT count(*) AS n FROM (SELECT DISTINCT t.id FROM t JOIN e ON e.id = t.entry_id JOIN db ON db.phrase = t.normalized_phrase AND db.entry_id = t.entry_id WHERE t.state IN ('auto_active', 'approved') AND e.enabled AND NOT e.removed_from_source AND {_SAFE.format('db.url')})")
def linking_count(c: Catalog) -> DataFrame:
    t = c.terms.where(linkable()).withColumnRenamed("normalized_phrase", "np")
    e = c.entries.where(F.col("enabled") & ~F.col("removed_from_source")).select(F.col("id").alias("entry_id"))
    pairs = rules.linking_pairs(db_rules(c)).withColumnRenamed("phrase", "np")
    return t.join(e, "entry_id", "left_semi").join(pairs, ["np", "entry_id"], "left_semi").agg(F.count(F.lit(1)).alias("n"))


@query(SCANNED + "SELECT * FROM hits")
def scan_matches(c: Catalog) -> DataFrame:
    return scan(text_posts(c), ruleset(c)).drop("node_index")


@query(resolved_sql(1, 0) + "SELECT * FROM links")
def resolve_matches(c: Catalog) -> DataFrame:
    r = ruleset(c)
    return resolve(scan(text_posts(c), r), r).select("doc_id", "start", "length", "phrase", "url")


@query(resolved_sql(2, 3) + "SELECT * FROM links")
def resolve_capped(c: Catalog) -> DataFrame:
    r = ruleset(c)
    return resolve(scan(text_posts(c), r), r, per_destination=2, total=3).select("doc_id", "start", "length", "phrase", "url")


@query(resolved_sql(1, 0) + "SELECT lp.id AS doc_id, count(l.phrase) AS n_links FROM lp LEFT JOIN links l ON l.doc_id = lp.id GROUP BY lp.id")
def link_counts(c: Catalog) -> DataFrame:
    r, nodes = ruleset(c), text_posts(c)
    per = resolve(scan(nodes, r), r).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    return nodes.select("doc_id").join(per, "doc_id", "left").select("doc_id", F.coalesce("n", F.lit(0)).alias("n_links"))


_TAG = "'<a href=\"' || replace(replace(replace(l.url, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') || '\" class=\"autolink autolink-' || rs.type || '\" data-autolink=\"true\" data-autolink-type=\"' || rs.type || '\" data-autolink-term=\"' || replace(replace(replace(l.phrase, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;') || '\"' || coalesce(' data-autolink-id=\"' || rs.entry_id || '\"', '') || '>'"


@query(
    resolved_sql(1, 0) + ", ls AS (SELECT l.doc_id, l.start, l.length, " + _TAG + " AS tag, row_number() OVER (PARTITION BY l.doc_id ORDER BY l.start) AS k, lead(l.start) OVER (PARTITION BY l.doc_id ORDER BY l.start) AS nxt FROM links l JOIN rs USING (phrase)), "
    "body AS (SELECT ls.doc_id, string_agg(CASE WHEN k = 1 THEN raw[:start] ELSE '' END || tag || raw[start + 1:start + length] || '</a>' || CASE WHEN nxt IS NULL THEN raw[start + length + 1:] ELSE raw[start + length + 1:nxt] END, '' ORDER BY start) AS rendered FROM ls JOIN lp ON lp.id = ls.doc_id GROUP BY ls.doc_id) "
    "SELECT lp.id AS doc_id, coalesce(b.rendered, lp.raw) AS rendered FROM lp LEFT JOIN body b ON b.doc_id = lp.id"
)
def render_links(c: Catalog) -> DataFrame:
    r, nodes = ruleset(c), text_posts(c)
    return render.render_text(nodes, resolve(scan(nodes, r), r), ["doc_id"]).select("doc_id", "rendered")


def html_posts(c: Catalog) -> DataFrame:
    return linkable_posts_op(c.posts, categories(c), SETTINGS).where(F.col("cooked").isNotNull()).select(F.col("id").alias("doc_id"), "cooked")


@query()
def text_nodes(c: Catalog) -> DataFrame:
    return render.text_nodes(html_posts(c), "doc_id", "cooked")


@query()
def scan_nodes(c: Catalog) -> DataFrame:
    return scan(text_nodes(c), ruleset(c))


@query()
def render_html(c: Catalog) -> DataFrame:
    r, posts = ruleset(c), html_posts(c)
    links = resolve(scan(render.text_nodes(posts, "doc_id", "cooked"), r), r)
    return render.render_html(posts, links, "doc_id", "cooked").select("doc_id", "rendered", "n_links")


#: The same over the documents table: whole texts, all rows.
@query(resolved_sql(1, 0, RULES + hits_sql("SELECT doc_id, text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL", "rs")) + "SELECT * FROM links")
def document_links(c: Catalog) -> DataFrame:
    r = ruleset(c)
    nodes = render.plain_nodes(c.raw("documents").where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()), "doc_id", "text")
    return resolve(scan(nodes, r), r).select("doc_id", "start", "length", "phrase", "url")
