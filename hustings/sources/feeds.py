"""Feeds and sitemaps: documents to entries, as expressions over XML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hustings.functions.dates import feed_time

_PAGE = "array<struct<loc:string,lastmod:string>>"
_ITEM = "array<struct<title:string,link:string,pubDate:string>>"
#: What the parser takes of a document, whatever its root; a document that it refuses is in ``_corrupt``.
SCHEMA = (
    f"channel array<struct<item:{_ITEM}>>, item {_ITEM}, entry array<struct<title:string,link:array<struct<_href:string>>,updated:string,published:string>>, "
    f"url {_PAGE}, sitemap {_PAGE}, _corrupt string"
)
OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt", "ignoreNamespace": "true", "attributePrefix": "_", "nullValue": "\x00"}


def parsed_xml(c: Column) -> Column:
    """The document as a struct of ``SCHEMA``; null without one."""
    return F.from_xml(F.when(F.trim(c) != "", c), SCHEMA, OPTIONS)


def root_tag(c: Column) -> Column:
    """Local name of a document's root element, in lower case; '' without one."""
    bare = F.regexp_replace(c, r"(?s)^\s*(<\?.*?\?>\s*|<!--.*?-->\s*|<!DOCTYPE[^>]*>\s*)*", "")
    return F.lower(F.regexp_extract(bare, r"^<(?:[\w.-]+:)?([\w.-]+)", 1))


def well_formed(c: Column) -> Column:
    """Whether the XML parser takes the document and its root is a feed's or a sitemap's; errors never stop a job."""
    x, root = parsed_xml(c), root_tag(c)
    # the parser stops at the end of the root: nothing but comments may come after it
    rest = r"\s*(?:<!--.*?-->\s*)*$"
    closed = F.regexp_extract(F.lower(c), r"(?s)</(?:[\w.-]+:)?([\w.-]+)\s*>" + rest, 1) == root
    return root.isin("rss", "feed", "rdf", "urlset", "sitemapindex") & x.isNotNull() & x["_corrupt"].isNull() & (closed | c.rlike("(?s)/>" + rest))


def is_index(c: Column) -> Column:
    return (root_tag(c) == "sitemapindex") | (F.coalesce(F.size(parsed_xml(c)["sitemap"]), F.lit(0)) > 0)


_ROW = "struct<title:string,link:string,published:string>"


def _entry(title: Column, link: Column, published: Column) -> Column:
    def text(x: Column) -> Column:
        # what feeds put into CDATA is often escaped once more
        x = F.coalesce(F.trim(x), F.lit(""))
        for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&amp;", "&")):
            x = F.replace(x, F.lit(entity), F.lit(char))
        return x

    return F.struct(text(title).alias("title"), text(link).alias("link"), text(published).alias("published"))


def _each(rows: Column, make) -> Column:
    return F.coalesce(F.transform(rows, make), F.array().cast(f"array<{_ROW}>"))


def entries_of(c: Column, x: Column | None = None) -> Column:
    """Array of (title, link, published) of a document: items of RSS, entries of Atom, or URLs of a sitemap, whose
    title is their location. x: the document as ``parsed_xml`` gives it, if it is at hand."""
    x = parsed_xml(c) if x is None else x
    none = F.array().cast(_ITEM)
    inner = F.flatten(F.transform(F.coalesce(x["channel"], F.array().cast(f"array<struct<item:{_ITEM}>>")), lambda k: F.coalesce(k["item"], none)))
    items = _each(F.concat(inner, F.coalesce(x["item"], none)), lambda i: _entry(i["title"], i["link"], i["pubDate"]))
    stamp = lambda e: F.coalesce(F.nullif(F.trim(e["updated"]), F.lit("")), e["published"])
    atoms = _each(x["entry"], lambda e: _entry(e["title"], F.get(e["link"], F.lit(0))["_href"], stamp(e)))
    urls = _each(x["url"], lambda u: _entry(u["loc"], u["loc"], u["lastmod"]))
    root = root_tag(c)
    return F.when(root == "urlset", urls).when(root.isin("rss", "rdf"), items).when(root == "feed", atoms).otherwise(F.array().cast(f"array<{_ROW}>"))


def children_of(c: Column) -> Column:
    """Array of (loc, lastmod) of a sitemap index in document order; lastmod null if it isn't told."""
    rows = F.coalesce(parsed_xml(c)["sitemap"], F.array().cast(_PAGE))
    return F.transform(rows, lambda s: F.struct(F.coalesce(F.trim(s["loc"]), F.lit("")).alias("loc"), F.nullif(F.trim(s["lastmod"]), F.lit("")).alias("lastmod")))


def parse_documents(documents: DataFrame, text: str = "body") -> DataFrame:
    """documents with ``parsed`` and ``entries`` columns; a malformed one has no entries and parsed is false."""
    ok = well_formed(F.col(text)) & ~is_index(F.col(text))
    x = documents.withColumn("parsed", F.coalesce(ok, F.lit(False))).withColumn("_xml", F.when(F.col("parsed"), parsed_xml(F.col(text))))
    return x.withColumn("entries", F.when(F.col("parsed"), entries_of(F.col(text), F.col("_xml"))).otherwise(F.array().cast(f"array<{_ROW}>"))).drop("_xml")


def explode_entries(parsed: DataFrame, keep: list[str]) -> DataFrame:
    """One row for each entry, in the document's order, with its time."""
    rows = parsed.select(*keep, F.posexplode("entries").alias("entry_seq", "e"))
    return rows.select(*keep, "entry_seq", F.col("e.title").alias("title"), F.col("e.link").alias("link"), feed_time(F.col("e.published")).alias("published_at"))


def wanted_children(indexes: DataFrame, text: str, window_start: Column, most: int, keep: list[str]) -> DataFrame:
    """Children of sitemap indexes that may hold pages of the window: modified from the day before it on, or not
    told; the first ``most`` of each index in document order."""
    from hustings.functions.dates import fresh_enough

    fresh = F.filter(children_of(F.col(text)), lambda x: fresh_enough(feed_time(x["lastmod"]), window_start) & (x["loc"] != ""))
    return indexes.select(*keep, F.posexplode(F.slice(fresh, 1, most)).alias("child_seq", "c")).select(*keep, "child_seq", F.col("c.loc").alias("url"))
