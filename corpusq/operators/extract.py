"""Text, titles, dates, languages, categories and links of documents and pages."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusq.functions.text import categorize, clean_text, detect_language, detect_language_binary, extract_date, markdown_title_backfill, markdown_title_ingest, prefixes
from corpusq.operators.identity import title_backfill
from corpusq.registry import query, table

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
DROPPED = {"script", "style", "nav", "header", "footer", "aside"}


class Node:
    """An element: name, attributes, children (elements and strings)."""

    __slots__ = ("name", "attrs", "children")

    def __init__(self, name: str, attrs: dict[str, str]):
        self.name, self.attrs, self.children = name, attrs, []

    def walk(self, without=frozenset()):
        """This element and those below it in document order, but not the subtrees named in ``without``."""
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(c for c in reversed(node.children) if isinstance(c, Node) and c.name not in without)

    def texts(self, without=frozenset()) -> list[str]:
        out, stack = [], [self]
        while stack:
            node = stack.pop()
            if isinstance(node, str):
                out.append(node)
            else:
                stack.extend(c for c in reversed(node.children) if isinstance(c, str) or c.name not in without)
        return out

    def has_class(self, name: str) -> bool:
        return name in self.attrs.get("class", "").split()


class TreeBuilder(HTMLParser):
    """Elements as the tags open and close; an end tag closes what is open inside it, a stray one is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("[document]", {})
        self.open = [self.root]

    def handle_starttag(self, tag, attrs):
        node = Node(tag, {k: v or "" for k, v in attrs})
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.open[-1].children.append(Node(tag, {k: v or "" for k, v in attrs}))

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].name == tag:
                del self.open[i:]
                break

    def handle_data(self, data):
        last = self.open[-1].children
        if last and isinstance(last[-1], str):
            last[-1] += data
        else:
            last.append(data)


def tree(html: str | None) -> Node:
    b = TreeBuilder()
    b.feed(html or "")
    b.close()
    return b.root


def _first(root: Node, test, without=frozenset()) -> Node | None:
    return next((n for n in root.walk(without) if test(n)), None)


def main_text(html: str | None) -> tuple[str, str]:
    """(title, text) of a page without navigation and scripts: the first main element's text, cleaned; else the body's."""
    root = tree(html)
    tests = [lambda n: n.name == "article", lambda n: n.name == "main", lambda n: n.has_class("content"), lambda n: n.attrs.get("id") == "content", lambda n: n.has_class("post-content"), lambda n: n.name == "body"]
    content = next((x for t in tests if (x := _first(root, t, DROPPED))), None)
    heading = _first(root, lambda n: n.name == "h1", DROPPED) or _first(root, lambda n: n.name == "title", DROPPED)
    lines = [x.strip() for x in "\n".join(content.texts(DROPPED)).split("\n")] if content else []
    return ("".join(heading.texts(DROPPED)).strip() if heading else "Untitled"), "\n".join(x for x in lines if x)


def structured(html: str | None) -> tuple[str, str, str, dict[str, str]]:
    """(title, content, type, metadata) by class names, over the whole tree."""
    root = tree(html)
    text = lambda n: "\n".join(x.strip() for x in n.texts({"script", "style"}) if x.strip())
    title = _first(root, lambda n: n.name == "h1" or n.has_class("document-title") or n.has_class("title"))
    content = _first(root, lambda n: n.name in ("main", "article") or n.has_class("document-content") or n.has_class("content")) or _first(root, lambda n: n.name == "body")
    kind = _first(root, lambda n: n.has_class("document-type") or n.has_class("type"))
    meta = {n.attrs.get("data-meta-key") or n.attrs.get("class", ""): text(n) for n in root.walk() if "data-meta-key" in n.attrs or n.has_class("metadata-item")}
    return (text(title) if title else "Untitled"), (text(content) if content else ""), (text(kind) if kind else ""), meta


def page_main_text(pages: DataFrame, key: str = "page_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, title, text) and the string columns of ``keep`` of every page; a null page has no text."""

    def run(batches):
        for b in batches:
            found = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({key: b[key], "title": [t for t, _ in found], "text": [x for _, x in found], **{c: b[c] for c in keep}})

    return pages.select(key, "html", *keep).mapInPandas(run, ", ".join([f"{key} long, title string, text string", *(f"{c} string" for c in keep)]))


def structured_fields(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """(key, title, content, doc_type, metadata map) of every page."""

    def run(batches):
        for b in batches:
            found = [structured(h) for h in b["html"]]
            yield pd.DataFrame({key: b[key], "title": [x[0] for x in found], "content": [x[1] for x in found], "doc_type": [x[2] for x in found], "metadata": [x[3] for x in found]})

    return pages.select(key, "html").mapInPandas(run, f"{key} long, title string, content string, doc_type string, metadata map<string,string>")


def page_title(html: Column) -> Column:
    """First h1, else title, else ``Untitled``, by patterns alone."""
    of = lambda tag: F.nullif(F.trim(F.regexp_extract(html, f"<{tag}[^>]*>([^<]*)", 1)), F.lit(""))
    return F.coalesce(of("h1"), of("title"), F.lit("Untitled"))


def min_length_filter(df: DataFrame, text: str = "text", least: int = 100) -> DataFrame:
    """Rows whose text has ``least`` characters or more."""
    return df.where(F.length(text) >= least)


def netloc(url: Column) -> Column:
    """Host and port of a url; empty for a relative one."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def resolve_url(base: Column, link: Column) -> Column:
    """Absolute form of a link on the page ``base``: absolute, //host, /root, ?query, #fragment and relative ones."""
    origin = F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    path = F.regexp_extract(base, r"^([^?#]*)", 1)
    query_free = F.regexp_extract(base, r"^([^#]*)", 1)
    folder = F.when(F.length(path) > F.length(origin), F.regexp_extract(path, r"^(.*/)", 1)).otherwise(F.concat(origin, F.lit("/")))
    whole = F.when(link.startswith("/"), F.concat(origin, link)).otherwise(F.concat(folder, link))
    parts = F.split(F.substring(F.regexp_extract(whole, r"^([^?#]*)", 1), F.length(origin) + 1, F.length(whole)), "/")
    inner = F.filter(parts, lambda x, i: (x != "") | (i == 0) | (i == F.size(parts) - 1))  # relative references lose empty parts
    parts = F.when(link.startswith("/"), parts).otherwise(inner)
    ends = F.element_at(parts, -1).isin(".", "..")
    step = lambda done, x: F.when(x == ".", done).when(x == "..", F.when(F.size(done) > 1, F.slice(done, 1, F.size(done) - 1)).otherwise(done)).otherwise(F.concat(done, F.array(x)))
    path_of = F.aggregate(F.concat(parts, F.when(ends, F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))), F.array().cast("array<string>"), step)
    joined = F.concat(origin, F.array_join(path_of, "/"), F.regexp_extract(whole, r"^[^?#]*(.*)$", 1))
    return (
        F.when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(F.regexp_extract(base, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), link))
        .when(link.startswith("?"), F.concat(path, link))
        .when(link.startswith("#"), F.concat(query_free, link))
        .when(link == "", query_free)
        .otherwise(joined)
    )


#: The href of an anchor: quoted either way or not at all.
HREF = r"""(?is)<a\s(?:[^>]*?\s)?href\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""
#: Entities of markup in attributes; the ampersand's comes last.
ENTITIES = {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&#x27;": "'", "&#38;": "&", "&amp;": "&"}


def extract_links(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """Distinct absolute links (key, url, link) of every page's anchors, whatever their case, white space and quotes."""
    found = pages.select(key, "url", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit(HREF), F.lit(1)))).alias("href"))
    href = F.regexp_replace("href", r"""^(["'])(.*)\1$""", "$2")
    for name, c in ENTITIES.items():
        href = F.replace(href, F.lit(name), F.lit(c))
    found = found.withColumn("href", F.trim(href))
    return found.select(key, "url", resolve_url(F.col("url"), F.col("href")).alias("link")).distinct()


def same_domain(links: DataFrame) -> DataFrame:
    """Links to the page's own host and port."""
    return links.where(netloc(F.col("link")) == netloc(F.col("url")))


def relevant_links(links: DataFrame, visited: DataFrame, keywords: list[str], key: str = "page_id", most: int = 10) -> DataFrame:
    """The first ``most`` links of a page, by url, that hold a keyword, stay on the host and have not been visited."""
    hit = F.lit(False)
    for k in keywords:
        hit = hit | F.lower("link").contains(k)
    new = same_domain(links).where(hit).join(visited.select(F.col("url").alias("link")), "link", "left_anti")
    return new.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy("link"))).where(F.col("rank") <= most)


def document_links(links: DataFrame, host: str, word: str = "document") -> DataFrame:
    """Links that hold the site's host and, in any case, the word."""
    return links.where(F.col("link").contains(host) & F.lower("link").contains(word))


def link_param_values(links: DataFrame, name: str) -> DataFrame:
    """Distinct values of a query parameter in links."""
    return links.select(F.regexp_extract("link", f"{name}=([^&]*)", 1).alias("value")).where(F.col("link").contains(f"{name}=")).distinct()


def url_policy_filter(urls: DataFrame, policy: DataFrame, agent: str = "*") -> DataFrame:
    """Urls with ``allowed``: by the first rule (by seq) of their host whose prefix fits the path; true without one.

    Each distinct path is cut to prefixes of the lengths that its host's rules have, and these meet the rules by equality,
    so a host with many rules and many urls is no join of all with all.
    """
    host, path = netloc(F.col("url")), F.regexp_extract("url", r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)", 1)
    u = urls.withColumn("_host", host).withColumn("_path", path)
    p = policy.where(((F.col("agent") == agent) | (F.col("agent") == "*")) & F.col("prefix").isNotNull()).select(F.col("host").alias("_host"), F.col("prefix").alias("_prefix"), "allow", "seq")
    rules = p.groupBy("_host", "_prefix").agg(F.min(F.struct("seq", "allow")).alias("_rule"))
    lengths = rules.groupBy("_host").agg(F.collect_set(F.length("_prefix")).alias("_lengths"))  # at most the longest prefix
    cut = prefixes(u.select("_host", "_path").distinct().join(lengths, "_host"), "_path", "_lengths", "_prefix")
    first = cut.join(rules, ["_host", "_prefix"]).groupBy("_host", "_path").agg(F.min("_rule").alias("_rule"))
    return u.join(first, ["_host", "_path"], "left").select(*urls.columns, F.coalesce("_rule.allow", F.lit(True)).alias("allowed"))


@query()
def page_main_text_pages(spark, sf_dir):
    return page_main_text(table(spark, sf_dir, "pages"))


@query()
def structured_fields_pages(spark, sf_dir):
    return structured_fields(table(spark, sf_dir, "pages")).withColumn("metadata", F.to_json("metadata"))


@query(r"SELECT doc_id, md5(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> ''), chr(10))) AS clean_md5 FROM documents")
def clean_text_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(clean_text(F.col("text"))).alias("clean_md5"))


@query("SELECT page_id, coalesce(nullif(trim(regexp_extract(html, '<h1[^>]*>([^<]*)', 1)), ''), nullif(trim(regexp_extract(html, '<title[^>]*>([^<]*)', 1)), ''), 'Untitled') AS title FROM pages")
def page_title_pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", page_title(F.col("html")).alias("title"))


@query(r"SELECT doc_id, coalesce(nullif(regexp_extract(text, '(\d{1,2}[./-]\d{1,2}[./-]\d{2,4})', 1), ''), nullif(regexp_extract(text, '(\d{4}[./-]\d{1,2}[./-]\d{1,2})', 1), '')) AS doc_date FROM documents")
def extract_date_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", extract_date(F.col("text")).alias("doc_date"))


@query("SELECT page_id, CASE WHEN contains(url, '/en/') OR contains(lower(html), 'license') THEN 'english' WHEN contains(url, '/de/') THEN 'german' WHEN contains(url, '/fr/') OR contains(html, 'ç') THEN 'french' END AS category FROM pages")
def categorize_pages(spark, sf_dir):
    rules = [("english", "/en/", [], ["license"]), ("german", "/de/", [], []), ("french", "/fr/", ["ç"], [])]
    return table(spark, sf_dir, "pages").select("page_id", categorize(F.col("url"), F.col("html"), rules).alias("category"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{10A0}-\x{10FF}]') THEN 'ka' WHEN regexp_matches(text, '[\x{0400}-\x{04FF}]') THEN 'ru' ELSE 'en' END AS language FROM documents")
def detect_language_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect_language(F.col("text")).alias("language"))


@query(r"SELECT doc_id, CASE WHEN regexp_matches(text, '[\x{10A0}-\x{10FF}]') THEN 'ka' ELSE 'en' END AS language FROM documents")
def detect_language_binary_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", detect_language_binary(F.col("text")).alias("language"))


@query("SELECT doc_id, length(text) AS n FROM documents WHERE length(text) >= 100")
def min_length_filter_documents(spark, sf_dir):
    return min_length_filter(table(spark, sf_dir, "documents")).select("doc_id", F.length("text").cast("long").alias("n"))


_LINKS = r"""WITH l AS (SELECT DISTINCT page_id, url, CASE WHEN regexp_matches(h, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN h WHEN starts_with(h, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1) || h
ELSE regexp_extract(regexp_extract(url, '^([^?#]*)', 1), '^(.*/)', 1) || h END AS link
FROM (SELECT page_id, url, unnest(regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)) AS h FROM pages))
"""


@query(_LINKS + "SELECT page_id, url, link FROM l")
def extract_links_pages(spark, sf_dir):
    return extract_links(table(spark, sf_dir, "pages"))


_SAME = r" regexp_extract(link, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) = regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"


@query(_LINKS + "SELECT page_id, url, link FROM l WHERE" + _SAME)
def same_domain_pages(spark, sf_dir):
    return same_domain(extract_links(table(spark, sf_dir, "pages")))


@query(_LINKS + ", r AS (SELECT page_id, url, link, row_number() OVER (PARTITION BY page_id ORDER BY link) AS rank FROM l WHERE (contains(lower(link), 'the') OR contains(lower(link), 'p')) AND link NOT IN (SELECT url FROM pages) AND" + _SAME + ") SELECT page_id, url, link, rank FROM r WHERE rank <= 10")
def relevant_links_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return relevant_links(extract_links(pages), pages, ["the", "p"]).select("page_id", "url", "link", "rank")


@query(_LINKS + "SELECT page_id, link FROM l WHERE contains(link, 'example.org') AND contains(lower(link), 'p')")
def document_links_pages(spark, sf_dir):
    return document_links(extract_links(table(spark, sf_dir, "pages")), "example.org", "p").select("page_id", "link")


_TITLE_LINES = r"""WITH c AS (SELECT doc_id, i, CASE WHEN contains(x, ' the ') THEN regexp_replace(x[:strpos(x, ' the ') - 1], '^\s+|\s+$', '', 'g') WHEN starts_with(x, '#') THEN regexp_replace(ltrim(x, '#'), '^\s+|\s+$', '', 'g') ELSE x[:200] END AS t,
CASE WHEN contains(x, ' the ') THEN true WHEN starts_with(x, '#') THEN regexp_replace(ltrim(x, '#'), '^\s+|\s+$', '', 'g') NOT IN ('', 'Document statistics') ELSE true END AS e
FROM (SELECT doc_id, i, regexp_replace(ls[i], '^\s+|\s+$', '', 'g') AS x FROM (SELECT doc_id, string_split(text, chr(10)) AS ls, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents))
WHERE x <> '' AND (contains(x, ' the ') OR starts_with(x, '#') OR (length(x) > 10 AND NOT starts_with(x, '[') AND NOT starts_with(x, '!'))))
"""


@query(_TITLE_LINES + "SELECT d.doc_id, coalesce(min_by(c.t, c.i) FILTER (WHERE c.e), max_by(c.t, c.i), 'Untitled') AS title FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def markdown_title_ingest_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markdown_title_ingest(F.col("text"), " the ").alias("title"))


@query(_TITLE_LINES + "SELECT d.doc_id, coalesce(min_by(c.t, c.i) FILTER (WHERE c.e AND c.t <> ''), 'Untitled') AS title FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id")
def markdown_title_backfill_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", markdown_title_backfill(F.col("text"), " the ").alias("title"))


@query(_TITLE_LINES + """, t AS (SELECT d.doc_id, CASE WHEN d.doc_id % 2 = 0 THEN coalesce(min_by(c.t, c.i) FILTER (WHERE c.e AND c.t <> ''), 'Untitled') ELSE 'Untitled' END AS title, coalesce(min_by(c.t, c.i) FILTER (WHERE c.e AND c.t <> ''), 'Untitled') AS new_title
FROM documents d LEFT JOIN c ON c.doc_id = d.doc_id GROUP BY d.doc_id) SELECT t.doc_id, t.title, t.new_title, len(string_split(d.text, chr(10))) AS chunk_updates FROM t JOIN documents d ON d.doc_id = t.doc_id WHERE t.title <> t.new_title""")
def title_backfill_documents(spark, sf_dir):
    d = table(spark, sf_dir, "documents", "doc_id", "text")
    stored = d.withColumn("title", F.when(F.col("doc_id") % 2 == 0, markdown_title_backfill(F.col("text"), " the ")).otherwise("Untitled"))
    chunks = d.select("doc_id", F.explode(F.split("text", "\n")).alias("content"))
    return title_backfill(stored, chunks, " the ")


@query("SELECT DISTINCT regexp_extract(url, 'page=([^&]*)', 1) AS value FROM pages WHERE contains(url, 'page=')")
def link_param_values_pages(spark, sf_dir):
    return link_param_values(table(spark, sf_dir, "pages").select(F.col("url").alias("link")), "page")


@query(r"""
WITH h AS (SELECT DISTINCT regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host FROM pages),
p AS (SELECT host, '/en/1' AS prefix, true AS allow, 1 AS seq FROM h WHERE starts_with(host, 'm.') UNION ALL SELECT host, '/en/', false, 2 FROM h UNION ALL SELECT host, '/de/', false, 3 FROM h WHERE starts_with(host, 'blog.')),
u AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1) AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^#]*)', 1) AS path FROM pages)
SELECT u.page_id, u.url, coalesce((SELECT min_by(p.allow, p.seq) FROM p WHERE p.host = u.host AND starts_with(u.path, p.prefix)), true) AS allowed FROM u
""")
def url_policy_filter_pages(spark, sf_dir):
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    h = pages.select(netloc(F.col("url")).alias("host")).distinct()
    rule = lambda d, prefix, allow, seq: d.select("host", F.lit("*").alias("agent"), F.lit(prefix).alias("prefix"), F.lit(allow).alias("allow"), F.lit(seq).alias("seq"))
    policy = rule(h.where(F.col("host").startswith("m.")), "/en/1", True, 1).unionByName(rule(h, "/en/", False, 2)).unionByName(rule(h.where(F.col("host").startswith("blog.")), "/de/", False, 3))
    return url_policy_filter(pages, policy)

