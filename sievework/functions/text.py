"""Text columns: trimming, list answers, durations, errors, budgets and prompts. All are JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What marks a text, or a script, that was cut or taken away.
MARKER, REMOVED = "\n[TRUNCATED]\n", "[Removed due to token limits]\n"
SCRIPT_MARKER, SCRIPT_REMOVED = "\n% [TRUNCATED: script shortened to fit model context]\n", "% [Model script removed due to token limits]\n"
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def strip(c) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def number(c) -> Column:
    """The number that a text is, or null; texts such as 1d or 1.5f are none."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.rlike(NUMBER), strip(c).try_cast("double"))


def names(c) -> Column:
    """The names in a text split at commas and semicolons, without blanks."""
    return F.filter(F.transform(F.split(c, "[,;]"), strip), lambda x: x != "")


def listed_names(c) -> Column:
    """The names of a list written as text: one bracket pair around it goes, then quotes at the ends of each part between commas."""
    s = strip(c)
    s = F.when(s.startswith("[") & s.endswith("]") & (F.char_length(s) > 1), F.substring(s, F.lit(2), F.char_length(s) - 2)).otherwise(s)
    parts = F.filter(F.transform(F.split(s, ","), strip), lambda p: p != "")
    return F.filter(F.transform(parts, lambda p: F.regexp_replace(p, "^[\"']+|[\"']+$", "")), lambda p: p != "")


def declared(c) -> Column:
    """The name that a text declares: that of the first predicate, function, annotation or constraint with arguments; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"\b(?:predicate|function|annotation|constraint)\b\s+([A-Za-z_]\w*)\s*\(", 1), F.lit(""))


def tightened(c) -> Column:
    """A text in one line: white space in one blank, 'as [ b ]' as 'as[b]', none inside brackets' ends or before commas, one blank
    behind commas and on either side of an operator that has some there."""
    c = F.regexp_replace(strip(F.replace(c, F.lit("\u00a0"), F.lit(" "))), r"\s+", " ")
    c = F.regexp_replace(c, r"\b(\w+)\s*\[\s*([^\]]+?)\s*\]", "$1[$2]")
    for pattern, to in [(r"\(\s+", "("), (r"\s+\)", ")"), (r"\s+,", ","), (r",\s+", ", ")]:
        c = F.regexp_replace(c, pattern, to)
    return F.regexp_replace(c, r"\s+(=|<=|>=|<|>)\s+", " $1 ")


def first_bracket(c) -> Column:
    """What stands in the first [...]; null if there is none."""
    return F.nullif(F.regexp_extract(c, r"\[([^\]]+)\]", 1), F.lit(""))


def after_bracket(c) -> Column:
    """The text behind the first [...], stripped; empty if there is none."""
    return strip(F.regexp_extract(c, r"(?s)\[[^\]]+\](.*)$", 1))


def pairs(c, reasoned: bool = False) -> Column:
    """Every 'name: [list]' of a text, as structs of name and list; a name is what stands before the colon in its line.

    ``reasoned``: with tail, the rest of the line behind the list, or the next line with a text if that is blank, null if there is none.
    """
    pattern = F.lit(r"([^:\n]+)\s*:\s*\[([^\]]+)\]" + (r"\s*(.*)" if reasoned else ""))
    found = F.transform(F.regexp_extract_all(c, pattern, F.lit(1)), strip)
    parts = [found.alias("name"), F.regexp_extract_all(c, pattern, F.lit(2)).alias("list")]
    if reasoned:
        parts.append(F.transform(F.regexp_extract_all(c, pattern, F.lit(3)), lambda t: F.nullif(strip(t), F.lit(""))).alias("tail"))
    return F.arrays_zip(*parts)


def brackets(c) -> Column:
    """The insides of all [...] of a text, in order."""
    return F.regexp_extract_all(c, F.lit(r"\[([^\]]+)\]"), F.lit(1))


def seconds(c) -> Column:
    """Whole seconds of the durations, such as 24m8.928s, behind 'try again in', else behind 'try again after'; all parts are
    added up. Null if they come to nothing."""
    phrase = lambda word: F.nullif(F.regexp_extract(c, rf"(?i)try again {word}\s+([0-9hms.\s]+)", 1), F.lit(""))
    found = F.lower(F.coalesce(phrase("in"), phrase("after")))
    parts = F.arrays_zip(F.regexp_extract_all(found, F.lit(r"(\d+(?:\.\d+)?)([hms])"), F.lit(1)).alias("n"), F.regexp_extract_all(found, F.lit(r"(\d+(?:\.\d+)?)([hms])"), F.lit(2)).alias("unit"))
    worth = lambda p: p.n.cast("double") * F.when(p.unit == "h", 3600).when(p.unit == "m", 60).otherwise(1)
    total = F.aggregate(parts, F.lit(0.0), lambda s, p: s + worth(p))
    return F.when(total > 0, F.floor(total).cast("long"))


def error_policy(c) -> Column:
    """Which retry rule an error text falls under; the first that fits."""
    low = F.lower(c)
    has = lambda *words: [low.contains(w) for w in words]

    def any_of(found):
        out = found[0]
        for x in found[1:]:
            out = out | x
        return out

    return (
        F.when(any_of(has("rate_limit", "tpm", "429", "token")), "rate")
        .when(low.contains("resource_exhausted"), "exhausted")
        .when(any_of(has("503", "unavailable", "overloaded")), "unavailable")
        .when(any_of(has("413", "context_length", "too large")), "too_large")
        .otherwise("other")
    )


def wait(policy) -> Column:
    """Seconds to wait under a retry rule."""
    policy = F.col(policy) if isinstance(policy, str) else policy
    return F.when(policy.isin("rate", "too_large"), 60).when(policy.isin("exhausted", "unavailable"), 30)


def backoff(attempt, cap: int = 60) -> Column:
    return F.least(F.pow(F.lit(2.0), attempt), F.lit(float(cap))).cast("long")


def tokens(c) -> Column:
    """An estimate: a quarter of the characters, at least 1, and 0 for an empty text."""
    n = F.char_length(F.coalesce(c, F.lit("")))
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / 4))).cast("long")


def truncated(c, budget: int | Column, script: bool = False, marker: str | None = None) -> Column:
    """A text cut to a budget of estimated tokens, marked where it was cut; nothing but a mark without a budget. Scripts have marks of their own."""
    mark, removed = (SCRIPT_MARKER, SCRIPT_REMOVED) if script else (MARKER, REMOVED)
    budget = budget if isinstance(budget, Column) else F.lit(budget)
    keep = F.greatest(F.lit(20), 4 * budget).cast("int")
    cut = F.concat(F.regexp_replace(F.substring(c, F.lit(1), keep), r"\s+$", ""), F.lit(marker or mark))
    return F.when(budget <= 0, removed).when(tokens(c) <= budget, c).otherwise(cut)


def decimals(c, places: int) -> Column:
    """A number's text cut to so many decimals, never rounded; other texts and scientific notation as they are."""
    keep = rf"\.\d{{{places}}}" if places else ""
    return F.regexp_replace(c, rf"^(\s*[+-]?\d+{keep}){'' if places else chr(92) + '.'}\d+(\s*)$", "$1$2")


def key_of_path(c, roots: tuple[str, ...] = ()) -> Column:
    """The key of a file: its path below the first of ``roots`` that it lies under, else its folder and name; null for a bare name. Either slash separates."""
    c = F.replace(c, F.lit("\\"), F.lit("/"))
    out = F.nullif(F.regexp_extract(c, r"([^/]*/[^/]*)$", 1), F.lit(""))
    for root in reversed(roots):
        root = root.rstrip("/") + "/"
        out = F.when(c.startswith(root) & (F.char_length(c) > len(root)), F.substring(c, F.lit(len(root) + 1), F.char_length(c))).otherwise(out)
    return out


def temperature(c) -> Column:
    """0.2 of a file name with T0p2 or T0.2."""
    return F.regexp_replace(F.regexp_extract(c, r"T(\d+(?:[p.]\d+)?)", 1), "p", ".").try_cast("double")


def percent(part, whole) -> Column:
    """Text such as 96.97%, rounded half to even; null without a whole."""
    return F.concat(F.bround(F.try_divide(F.lit(100.0) * part, whole), 2).cast("string"), F.lit("%"))


def letters(n) -> Column:
    """0, 25, 26, 702 as a, z, aa, aaa, and so on: every number has a name of its own."""
    n = (F.col(n) if isinstance(n, str) else n).cast("long")
    start = F.struct(n.alias("left"), F.lit("").alias("name"))
    # 14 letters are enough for any 64-bit number
    step = lambda s, _: F.when(s.left < 0, s).otherwise(F.struct(((s.left - s.left % 26) / 26 - 1).cast("long").alias("left"), F.concat(F.char((s.left % 26 + 97).cast("int")), s["name"]).alias("name")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(14)), start, step).getField("name")


def evaluation(answer, truth) -> dict[str, Column]:
    """How a list of names compares with the true one: matches by place, matches anywhere, and a verdict."""
    places = F.aggregate(F.zip_with(answer, truth, lambda a, b: F.when(a == b, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    anywhere = F.size(F.array_intersect(answer, truth))
    verdict = F.when((places == F.size(truth)) & (F.size(answer) == F.size(truth)), "exact").when(anywhere == F.size(truth), "permuted").when(anywhere > 0, "partial").otherwise("none")
    return {"places": places.cast("long"), "anywhere": anywhere.cast("long"), "verdict": verdict}
