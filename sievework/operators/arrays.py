"""Long arrays in model data cut short, annotations taken out, feature vectors laid out."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievework.operators.flatzinc import commas
from sievework.shipping import ship

MOST, KEEP, CHARS, KEEP_CHARS = 200, 30, 80, 80
#: White space, as a set of a pattern and as characters.
WHITE, BLANKS = r" \t\n\x0b\f\r", " \t\n\x0b\f\r"


def shape(inner: str) -> tuple[int, tuple[int, ...]]:
    """Elements and dimensions of a list's inside; lists of unlike shapes count as one dimension."""
    items = commas(inner)
    if not items or not items[0].startswith("["):
        return len(items), (len(items),)
    found = [shape(x[1:-1]) if x.startswith("[") and x.endswith("]") else (1, None) for x in items]
    total, dims = sum(n for n, _ in found), {d for _, d in found}
    return total, (len(items), *dims.pop()) if len(dims) == 1 and None not in dims else (total,)


def closing(text: str, at: int) -> int:
    depth = 0
    for i in range(at, len(text)):
        depth += (text[i] == "[") - (text[i] == "]")
        if not depth:
            return i
    return -1


def shortened(text: str, most: int = MOST, keep: int = KEEP, chars: int = CHARS, keep_chars: int = KEEP_CHARS, compat: bool = False) -> str:
    """Arrays above either bound cut, with a comment that gives their dimensions. ``compat`` writes the left side twice, as published data has it."""
    out, at = [], 0
    while (start := text.find("[", at)) >= 0:
        end = closing(text, start)
        if end < 0:
            break
        inner = text[start + 1 : end]
        n, dims = shape(inner)
        if n <= most and len(inner) <= chars:
            out.append(text[at : end + 1])
            at = end + 1
            continue
        cut = f"[{inner[:keep_chars]}... ]" if len(inner) > chars else f"[{', '.join(commas(inner)[:keep])}]"
        tail = re.compile(r"\s*([,;]?)").match(text, end + 1)
        mark = tail[1]
        out.append(text[at:start])
        if compat:
            line = text[text.rfind("\n", 0, start) + 1 : start]
            out.append(f"{line.rpartition('=')[0].rstrip()} = " if "=" in line else f"{line.rstrip()} ")
        out.append(f"{cut}{mark} // array too long to display, dimensions: ({','.join(map(str, dims))})\n")
        at = tail.end() if mark else end + 1
    return "".join(out) + text[at:]


def sanitized(files: DataFrame) -> DataFrame:
    """file, text and changed of each (file, text); a null text stays null."""

    def run(batches):
        for pdf in batches:
            new = [None if t is None else shortened(t) for t in pdf["text"]]
            yield pd.DataFrame({"file": pdf["file"], "text": new, "changed": [a is not None and a != b for a, b in zip(new, pdf["text"], strict=True)]})

    ship(files.sparkSession)
    return files.select("file", "text").mapInPandas(run, "file string, text string, changed boolean")


NAMED = rf"::[{WHITE}]*[\w:.]*"
PARTS = {True: re.compile(rf"[{WHITE}]*{NAMED}(?:[{WHITE}]*(?=\())?|\(|\)|[^():{WHITE}]+|[{WHITE}]+|:"), False: re.compile(rf"{NAMED}|\(|\)|[^():{WHITE}]+|[{WHITE}]+|:")}


def unannotated(text: str, arguments: bool = True) -> str:
    """A text without its annotations. See ``without_annotations``."""
    items = []
    for item in text.split(";"):
        out, depth, gone, after = [], 0, None, False  # gone: the level of the annotation's bracket that is open
        for part in PARTS[arguments].findall(item):
            if part == ")":
                depth -= 1
                if gone is None:
                    out.append(part)
                elif depth == gone:
                    gone = None
                after = False
                continue
            if part == "(":
                if after and gone is None:
                    gone = depth
                depth += 1
            mark = part.lstrip(BLANKS).startswith("::")
            after = mark if arguments else mark and not part.strip(BLANKS)[2:]
            if gone is None and not mark:
                out.append(part)
        items.append("".join(out))
    whole = ";".join(items)
    return whole if arguments else re.sub(f"[{WHITE}]{{2,}}", " ", whole)


def without_annotations(files: DataFrame, arguments: bool = True) -> DataFrame:
    """file and text of each (file, text) without its annotations: '::' and a bracket, or '::' and a name.

    ``arguments``: a name's bracket and the white space before '::' go too; without it they stay and runs of white space become one
    blank, as tools of older data have it. Brackets may be nested to any depth: a depth is counted along an item (up to a
    semicolon), and what lies between an annotation's bracket and its partner goes. A bracket without a partner reaches to the
    end of its item. A null text stays null. A text is one row's work: nothing is sorted or shuffled.
    """

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"file": pdf["file"], "text": [None if t is None else unannotated(t, arguments) for t in pdf["text"]]})

    ship(files.sparkSession)
    return files.select("file", "text").mapInPandas(run, files.select("file", "text").schema)


def features(rows: DataFrame, names: list[str], column: str = "values") -> DataFrame:
    """One row for each value of a comma-separated vector, with its name; a vector of another length raises an error."""
    values = F.split(column, r"\s*,\s*")
    fits = F.when(F.size(values) == len(names), values).otherwise(F.raise_error(F.concat(F.lit(f"expected {len(names)} values, found "), F.size(values).cast("string"))))
    zipped = F.arrays_zip(F.array(*map(F.lit, names)).alias("feature"), fits.alias("value"))
    keys = [c for c in rows.columns if c != column]
    return rows.select(*keys, F.inline(zipped)).withColumn("value", F.col("value").try_cast("double"))


def aligned(rows: DataFrame, key: str, order: str, columns: list[str], widths: list[int], last: str) -> DataFrame:
    """key and text of each key's rows, in order, as lines of columns padded to their widths and a last one as it is, under a head and a rule.

    A value longer than its column pushes the rest on. Lines are joined by a backslash and an n, as published reports have them.
    """
    pad = lambda c, n: F.when(F.char_length(c) < n, F.rpad(c, n, " ")).otherwise(c)
    line = F.concat_ws(" ", *(pad(F.coalesce(F.col(c).cast("string"), F.lit("")), n) for c, n in zip(columns, widths, strict=True)), F.coalesce(F.col(last).cast("string"), F.lit("")))
    head = " ".join([*(c.upper().ljust(n) for c, n in zip(columns, widths, strict=True)), last.upper()])
    lines = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("l")))), lambda x: x.l)
    return rows.groupBy(key).agg(F.array_join(F.concat(F.array(F.lit(head), F.lit("=" * (sum(widths) + 30))), lines), "\\n").alias("text"))
