"""Pages of documentation as a table (url, html): links, traversal from a start page, and the definitions that links lead to."""

from __future__ import annotations

from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.functions.text import declared, tightened
from sievework.rounds import Rounds
from sievework.shipping import ship
from sievework.sources.files import short_references

#: Classes of the links and of the tables that count, and what a page's address must contain.
LINK, TABLE, PAGES = ("reference", "internal"), "docutils", "lib-flatzinc-"
SCHEMA = "url string, links array<struct<place: int, link: string, fragment: string, marked: boolean>>, tables array<struct<ids: array<string>, declaration: string, cell: string>>"


class _Page(HTMLParser):
    """Links in order; and of each table of the class, the ids in front of it that no table has followed yet, the first row's
    preformatted text and the second row's first cell."""

    def __init__(self, url: str):
        super().__init__(convert_charrefs=True)
        self.url, self.links, self.tables, self.ids = url, [], [], []
        self.depth = self.row = 0
        self.take: tuple[str, str] | None = None  # tag that ends what is read, and where it goes
        self.pieces: list[str] = []

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        classes = (a.get("class") or "").split()
        if tag == "a" and (href := (a.get("href") or "").strip()):
            try:
                link, fragment = urldefrag(urljoin(self.url, href))
            except ValueError:  # no address
                link = None
            if link is not None:
                self.links.append((len(self.links), link, fragment, all(c in classes for c in LINK)))
        if a.get("id"):
            self.ids.append(a["id"])
        if tag == "table":
            self.depth += 1
            if TABLE in classes and self.depth == 1:
                self.tables.append({"ids": self.ids, "declaration": None, "cell": None})
                self.ids, self.row = [], 0
        if not (self.depth and self.tables):
            return
        self.row += tag == "tr"
        found = self.tables[-1]
        name = {("pre", 1): "declaration", ("td", 2): "cell"}.get((tag, self.row))
        if name and found[name] is None and self.take is None:
            self.take, self.pieces = (tag, name), []

    def handle_endtag(self, tag):
        if self.take and tag in (self.take[0], "tr", "table"):
            self.tables[-1][self.take[1]] = ("\n" if self.take[0] == "pre" else " ").join(x for p in self.pieces if (x := p.strip()))
            self.take = None
        if tag == "table" and self.depth:
            self.depth -= 1

    def handle_data(self, data):
        if self.take:
            self.pieces.append(data)


def read(pages: DataFrame) -> DataFrame:
    """url, links (place, link, fragment, marked) and tables (ids, declaration, cell) of each page; links are absolute.

    ``marked`` links have the classes of references inside the documentation. A null page has neither links nor tables.
    """

    def run(batches):
        for pdf in batches:
            out = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                p = _Page(url or "")
                p.feed(short_references(html or ""))
                p.close()
                out.append((url, [dict(zip(("place", "link", "fragment", "marked"), x, strict=True)) for x in p.links], p.tables))
            yield pd.DataFrame(out, columns=["url", "links", "tables"])

    ship(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(run, SCHEMA)


def traversed(links: DataFrame, start: str) -> DataFrame:
    """url, level and path of every page that links (url, place, link) lead to from ``start``, in the order of first sight.

    Breadth first: each round joins the pages seen last to their links and takes away, by anti-join, what was seen before. ``path`` has
    the places of the links that led to a page; ordering by level and path is the order in which a walk with a queue first
    sees the pages, so no round has to number its pages in one task. Links to pages without a row are seen, but lead nowhere.
    Each round is written to the shared folder; there are as many as the farthest page has links on its way.
    """
    spark = links.sparkSession
    rounds = Rounds(spark)
    edges = rounds.kept(links.filter(F.col("link").isNotNull()).groupBy("url", "link").agg(F.min("place").cast("int").alias("place")))
    last = rounds.kept(spark.range(1).select(F.lit(start).alias("url"), F.lit(0).alias("level"), F.array().cast("array<int>").alias("path")))
    seen = [last]
    while True:
        step = last.join(edges, "url").select(F.col("link").alias("url"), (F.col("level") + 1).alias("level"), F.concat("path", F.array("place")).alias("path"))
        new = step.groupBy("url").agg(F.min("level").alias("level"), F.min("path").alias("path"))
        last = rounds.kept(new.join(_union(seen).select("url"), "url", "left_anti"))
        if last.isEmpty():
            break
        seen.append(last)
    rounds.close(*seen)
    return _union(seen)


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.union(f)
    return out


def documented(pages: DataFrame, start: str, within: str = PAGES) -> DataFrame:
    """name and description of what the start page's references lead to, in one pass over the pages.

    A reference (page, fragment) counts once, at its first place, if it has a fragment and its page's address contains ``within``. It
    leads to the first table behind the element of that id; the table gives a name if its first row declares one and its
    second has a text. Of a name given again the last reference counts. A page given twice is read as its first row by html.
    """
    rounds = Rounds(pages.sparkSession)
    found = rounds.kept(read(pages.groupBy("url").agg(F.min("html").alias("html"))))
    links = found.filter(F.col("url") == start).select(F.explode("links").alias("l")).select("l.*").filter("marked and fragment <> ''").filter(F.col("link").contains(within))
    asked = links.groupBy(F.col("link").alias("url"), "fragment").agg(F.min("place").alias("place"))
    tables = found.select("url", F.explode("tables").alias("t")).select("url", F.explode("t.ids").alias("fragment"), declared(F.col("t.declaration")).alias("name"), tightened(F.col("t.cell")).alias("description"))
    met = asked.join(tables, ["url", "fragment"]).filter("name is not null and description <> ''")
    return met.groupBy("name").agg(F.max_by("description", F.struct("place", "description")).alias("description"))
