"""Where a record stands in the text that it came from, and the passage that shows it; patterns are made from each row's values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, escape_html, fold, let

#: Signs around a value that may have been added or lost when it was copied.
AROUND = r"\s«»\"'\-–—:;,.()\[\]"
#: Where a sentence, or an entry of a list, ends; and how an official's number is written.
SENTENCE_END = r"\.\s|\s*;\s*-"
NUMBER = r"M[Ll][Ee]\.?\s*([0-9][0-9 . ]{2,14}[A-Z]?)\b"
#: Characters behind a name that its number may begin in, and that are looked at.
NEAR, WINDOW = 15, 60
#: Characters of a passage whose sentence doesn't end.
LONGEST = 240


def _blank(c) -> Column:
    return F.coalesce(_col(c), F.lit(""))


def _quoted(c: Column) -> Column:
    """A pattern that matches a value as it stands."""
    return F.concat(F.lit(r"\Q"), F.replace(c, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def _loosely(c: Column) -> Column:
    """The same with any white space for a space, and either apostrophe for one."""
    out = F.replace(F.replace(_quoted(c), F.lit(" "), F.lit(r"\E\s+\Q")), F.lit("’"), F.lit("'"))
    return F.concat(F.lit("(?iU)"), F.replace(out, F.lit("'"), F.lit(r"\E['’]\Q")))


def _first(text: Column, pattern: Column) -> Column:
    """The place of the first match, from 0; null if there is none."""
    at = F.regexp_instr(text, pattern)
    return F.when(at > 0, at - 1)


def located(text, reference, awardee, obj) -> Column:
    """Where an award is printed: at its reference, else its awardee (of 6 characters or more), else the beginning of its object (of 25 or more); null where none is found."""
    bare = lambda c: F.regexp_replace(_blank(c), rf"^[{AROUND}]+|[{AROUND}]+$", "")
    base, thing = _blank(text), bare(obj)
    marks = [F.when(F.length(x) >= 6, x) for x in (bare(reference), bare(awardee))]
    marks.append(F.when(F.length(thing) >= 25, F.regexp_replace(F.substring(thing, 1, 60), " [^ ]*$", "")))
    return F.coalesce(*[F.when(m.isNotNull(), _first(base, _loosely(m))) for m in marks])


def number_after_name(text, name) -> Column:
    """The official's number that follows a full name; null if there is none, or if several are found."""
    words = F.filter(F.split(fold(_blank(name)), r"\s+"), lambda w: w != "")
    pattern = F.concat(F.lit("(?s)(?i:"), F.array_join(F.transform(words, _quoted), r"\s+"), F.lit(rf")(?=(.{{0,{WINDOW}}}))"))
    after = F.regexp_extract_all(fold(_blank(text)), pattern, F.lit(1))
    found = F.transform(after, lambda x: F.regexp_extract(x, rf"(?s)^.{{0,{NEAR}}}?{NUMBER}", 1))
    found = F.array_distinct(F.transform(F.filter(found, lambda x: x != ""), lambda x: F.upper(F.regexp_replace(x, r"[ . ]", ""))))
    return F.when((F.size(words) > 0) & (F.size(found) == 1), F.get(found, F.lit(0)))


def _last(text: Column, mark: str) -> Column:
    """The place of the last occurrence, from 0; -1 if there is none."""
    at = F.instr(F.reverse(text), mark[::-1])
    return F.when(at > 0, F.length(text) - at - len(mark) + 1).otherwise(-1)


def _span(text: Column, pattern: Column) -> Column:
    """(a, b) of the first match, from 0; null if there is none."""
    end = lambda at: F.when(at > 0, F.struct((at - 1).alias("a"), (at - 1 + F.length(F.regexp_substr(text, pattern))).alias("b")))
    return let(F.regexp_instr(text, pattern), end)


def _start(text: Column, at: Column) -> Column:
    """Where the sentence or the entry around a place begins."""

    def after(x: Column) -> Column:
        dash = let(_last(F.substring(x["before"], F.greatest(x["left"], F.lit(0)) + 1, F.length(x["before"])), "- "), lambda d: F.when(d >= 0, d + F.greatest(x["left"], F.lit(0))).otherwise(-1))
        return F.greatest(x["left"], dash, F.lit(0))

    before = F.substring(text, F.lit(1), at)
    left = let(before, lambda b: F.struct(b.alias("before"), F.greatest(_last(b, "\n"), _last(b, ". ") + 1).alias("left")))
    return let(let(left, after), lambda s: F.when(F.substring(text, s + 1, F.lit(2)).isin("- ", "\n-"), F.least(s + 2, at)).otherwise(s))


def passage(text, anchors: list[tuple]) -> Column:
    """The sentence around the first of the anchors, with those in it in <mark>, as HTML on one line; null if none occurs.

    ``anchors`` are (value, whether it is an official's number); numbers may be written with blanks and dots.
    """
    base = _blank(text)
    spans = []
    for value, number in anchors:
        v = _blank(value)
        if number:
            signs = F.regexp_extract_all(v, F.lit(r"([\p{L}\p{N}])"), F.lit(1))
            pattern = F.when(F.size(signs) >= 4, F.concat(F.lit("(?i)"), F.array_join(signs, r"[\s.]*")))
        else:
            pattern = F.when(v != "", F.concat(F.lit("(?iU)"), _quoted(v)))
        spans.append(_span(base, pattern))

    def bounds(x: Column) -> Column:
        first = F.get(x["found"], F.lit(0))
        rest = F.regexp_instr(F.substring(x["text"], first["b"] + 1, F.length(x["text"])), F.lit(SENTENCE_END))
        stop = let(rest, lambda r: F.when(r > 0, first["b"] + r).otherwise(F.least(first["b"] + LONGEST, F.length(x["text"]))))
        return F.struct(x["text"].alias("text"), x["found"].alias("found"), _start(x["text"], first["a"]).cast("int").alias("start"), stop.alias("stop"))

    def marked(x: Column) -> Column:
        piece = lambda a, b: escape_html(F.substring(x["text"], a + 1, b - a))

        def mark(done: Column, s: Column) -> Column:
            more = F.concat(done["html"], piece(done["at"], s["a"]), F.lit("<mark>"), piece(s["a"], s["b"]), F.lit("</mark>"))
            return F.when(s["a"] < done["at"], done).otherwise(F.struct(more.alias("html"), s["b"].alias("at")))

        inside = F.filter(x["found"], lambda s: (s["a"] >= x["start"]) & (s["b"] <= x["stop"]))
        made = F.aggregate(inside, F.struct(F.lit("").alias("html"), x["start"].alias("at")), mark)
        return let(made, lambda m: F.trim(F.regexp_replace(F.concat(m["html"], piece(m["at"], x["stop"])), r"(?U)\s+", " ")))

    found = let(F.struct(base.alias("text"), F.array_sort(F.array_compact(F.array(*spans))).alias("found")), lambda x: F.when(F.size(x["found"]) > 0, x))
    return let(found, lambda x: F.when(x.isNotNull(), let(bounds(x), marked)))
