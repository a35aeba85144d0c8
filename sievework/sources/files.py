"""CSV folders, model folders, HTML tables and pages of definitions."""

from __future__ import annotations

import re
from html import unescape
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievework.operators.taxonomy import filled
from sievework.shipping import ship

#: Delimiters of CSV files, the likeliest first.
DELIMITERS = [",", ";", "\t", "|"]
RESULT_COLUMNS = ["problem", "instance", "solver", "status", "time", "objective", "score", "score_incomplete", "score_area"]


def csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """CSV with a header and a declared schema, from a file or a folder and the folders in it."""
    return spark.read.csv(path, header=True, schema=schema, recursiveFileLookup=True, pathGlobFilter="*.csv")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """file and value of every line of the .csv files in a folder and the folders in it; bytes that are no UTF-8 are replaced."""
    raw = spark.read.text(path, recursiveFileLookup=True, pathGlobFilter="*.[cC][sS][vV]")
    return raw.select(F.col("_metadata.file_path").alias("file"), F.make_valid_utf8("value").alias("value"))


def dialects(lines: DataFrame) -> DataFrame:
    """file and delimiter: of the candidates that which splits the largest share of the file's lines into the same number of cells.

    Of equal shares the one with more cells counts, then the first candidate; a file that none splits has a comma. What stands
    in quotes and empty lines are left out. Every line counts, in one pass with partial sums.
    """
    bare = F.regexp_replace("value", '"(?:[^"]|"")*"', "")
    count = lambda d: F.char_length(bare) - F.char_length(F.replace(bare, F.lit(d)))
    tried = F.array(*(F.struct(F.lit(-k).alias("rank"), F.lit(d).alias("delimiter"), count(d).alias("n")) for k, d in enumerate(DELIMITERS)))
    found = lines.filter(F.trim("value") != "").select("file", F.explode(tried).alias("t")).groupBy("file", "t").agg(F.count("*").alias("c"))
    agree = found.groupBy("file", "t.rank", "t.delimiter").agg(F.max(F.when(F.col("t.n") > 0, F.struct("c", "t.n"))).alias("best"), F.sum("c").alias("lines"))
    share = F.coalesce(F.col("best.c") / F.col("lines"), F.lit(0.0))
    return agree.groupBy("file").agg(F.max_by("delimiter", F.struct(share, F.coalesce("best.n", F.lit(0)), "rank")).alias("delimiter"))


def cells(line: Column, delimiter: Column) -> Column:
    """The cells of a line: split at delimiters outside quotes; quotes around a cell go, doubled ones inside it are one. None for an empty line."""
    d = F.concat(F.lit("\\Q"), delimiter, F.lit("\\E"))
    each = F.concat(d, F.lit('("(?:[^"]|"")*"|(?:(?!'), d, F.lit(").)*)"))
    found = F.regexp_extract_all(F.concat(delimiter, line), each, F.lit(1))
    quoted = lambda x: (F.char_length(x) > 1) & x.startswith('"') & x.endswith('"')
    plain = F.transform(found, lambda x: F.when(quoted(x), F.replace(F.substring(x, F.lit(2), F.char_length(x) - 2), F.lit('""'), F.lit('"'))).otherwise(x))
    return F.when(line == "", F.array().cast("array<string>")).otherwise(plain)


def joined(parts: Column, delimiter: Column) -> Column:
    """Cells as a line again; those with a delimiter or a quote in quotes."""
    quote = lambda x: F.when(x.contains(delimiter) | x.contains('"'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(x)
    return F.aggregate(F.transform(parts, quote), F.lit(None).cast("string"), lambda s, x: F.coalesce(F.concat(s, delimiter, x), x), lambda s: F.coalesce(s, F.lit("")))


def csv_cells(lines: DataFrame) -> DataFrame:
    """file, delimiter and cells of each line (file, value), each file by its own delimiter: headers are lines like others.

    The delimiters, a row a file, are joined to the lines. A line end inside quotes ends the line.
    """
    return lines.join(dialects(lines), "file", "left").withColumn("delimiter", F.coalesce("delimiter", F.lit(DELIMITERS[0]))).select("file", "delimiter", cells(F.col("value"), F.col("delimiter")).alias("cells"))


def model_files(spark: SparkSession, path: str) -> DataFrame:
    """folder, file, kind (model, commented, instance) and text of .mzn, .dzn, .json and .fzn files below a folder."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.{mzn,dzn,json,fzn}")
    at = F.col("_metadata.file_path")
    rows = raw.select(F.regexp_extract(at, r"([^/]+)/[^/]+$", 1).alias("folder"), F.regexp_extract(at, r"([^/]+)$", 1).alias("file"), F.col("value").alias("text"))
    kind = F.when(F.col("file").rlike("commented.*\\.mzn$"), "commented").when(F.col("file").endswith(".mzn"), "model").when(F.col("file").endswith(".fzn"), "flat").otherwise("instance")
    return rows.withColumn("kind", kind)


def primary_models(files: DataFrame) -> DataFrame:
    """The model of each folder: the one named like it, else the first by name that isn't commented."""
    own = F.when(F.col("file") == F.concat("folder", F.lit(".mzn")), 0).otherwise(1)
    return files.filter("kind = 'model'").groupBy("folder").agg(F.min_by("file", F.struct(own, F.col("file"))).alias("file"))


#: Numeric character references of more digits than the last code point has, and zeros in front of others.
TOO_LARGE = re.compile(r"&#(?:0*[1-9][0-9]{7,}|[xX]0*[1-9A-Fa-f][0-9A-Fa-f]{6,});?")
ZEROS = re.compile(r"(&#[xX]?)0+(?=[0-9A-Fa-f])")


def short_references(html: str) -> str:
    """A page whose numeric references are all short: those of no character become the replacement character, as when decoded."""
    return ZEROS.sub(r"\1", TOO_LARGE.sub("\ufffd", html)) if "&#" in html else html


#: A page of nothing but tags without attributes and text, where a tag can be told without the parser.
PLAIN = re.compile(r"[^<]*(?:</?[A-Za-z][A-Za-z0-9]*>[^<]*)*")
TAG = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9]*)>")
#: Tags whose content isn't read as tags.
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "plaintext"}


def cell_texts(html: str) -> list[list[str]]:
    """Texts of the cells of each row of each table body; a plain page is cut at its tags, others go through the parser."""
    html = short_references(html)
    cut = TAG.split(html) if PLAIN.fullmatch(html) else []
    names = [x.lower() for x in cut[2::3]]
    p = _Cells()
    if cut and RAW.isdisjoint(names):
        for end, name, text in zip(cut[1::3], names, cut[3::3], strict=True):
            if end:
                p.handle_endtag(name)
            else:
                p.handle_starttag(name, [])
            if text and p.cell is not None:
                p.cell.append(unescape(text) if "&" in text else text)
    else:
        p.feed(html)
        p.close()
    return p.rows


class _Cells(HTMLParser):
    """Texts of the cells of each row of each table body."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.rows, self.body, self.cell = [], 0, None

    def handle_starttag(self, tag, attrs):
        self.body += tag == "tbody"
        if tag == "tr" and self.body:
            self.rows.append([])
        if tag == "td" and self.body and self.rows:
            self.cell = []

    def handle_endtag(self, tag):
        self.body -= tag == "tbody" and self.body > 0
        if tag in ("td", "tr") and self.cell is not None:
            self.rows[-1].append(" ".join("".join(self.cell).split()))
            self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.cell.append(data)


def table_rows(pages: DataFrame) -> DataFrame:
    """url, row and cells of every row of every table body of (url, html)."""

    def run(batches):
        for pdf in batches:
            out = []
            for url, html in zip(pdf["url"], pdf["html"], strict=True):
                out += [(url, i, c) for i, c in enumerate(cell_texts(html or "")) if c]
            yield pd.DataFrame(out, columns=["url", "row", "cells"])

    ship(pages.sparkSession)
    return pages.select("url", "html").mapInPandas(run, "url string, row long, cells array<string>")


def result_tables(pages: DataFrame) -> DataFrame:
    """Result rows of HTML tables: rows with fewer cells go, blank problems and instances are filled from above, TOTAL rows go."""
    rows = table_rows(pages).filter(F.size("cells") >= len(RESULT_COLUMNS))
    named = rows.select("url", "row", *(F.get("cells", F.lit(i)).alias(c) for i, c in enumerate(RESULT_COLUMNS)))
    return filled(named, "url", "row", ["problem", "instance"])


def definitions(pages: DataFrame) -> DataFrame:
    """name and description of two-column tables; of a name given again, the first by url and row counts."""
    rows = table_rows(pages).filter(F.size("cells") >= 2)
    return rows.groupBy(F.get("cells", F.lit(0)).alias("name")).agg(F.min_by(F.get("cells", F.lit(1)), F.struct("url", "row")).alias("description"))


def links(pages: DataFrame, prefix: str = "") -> DataFrame:
    """Each internal link once, with the first page and place that has it and how often it is there; fragments are cut off."""
    found = pages.select("url", F.posexplode(F.regexp_extract_all("html", F.lit("href=[\"']([^\"'#]+)"), F.lit(1))).alias("place", "link"))
    return found.filter(F.col("link").startswith(prefix)).groupBy("link").agg(F.min(F.struct("url", "place")).alias("first"), F.count("*").alias("n")).select("link", "first.url", "first.place", "n")
