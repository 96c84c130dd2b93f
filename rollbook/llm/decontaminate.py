"""Benchmark passages in documents, re-parameterised ones included.

Words are reduced to a template: lower case, no punctuation, numbers (in figures or words),
units after a number, and names (capitalised words but those that often open sentences)
replaced by typed placeholders, whose words are the slots. Names and numbers of several words
are one placeholder. Windows of ``WINDOW`` template words are hashed and joined with
those of the benchmark; an item of fewer words is one window of its own length, and the
documents' windows of that length are hashed as well. Windows with too few words that
aren't names or numbers would match anything, so they are asked for word by word instead.

What matches is checked for its slots: an item's windows in a document must agree on what
each of the item's slot words was replaced by, and different slot words mustn't become one.
That is judged for each occurrence of an item (windows whose places are moved by nearly the
same distance), so that a true copy isn't excused by a variant elsewhere in the document,
and over the whole document, for copies that are torn apart.

DataFrame functions only. The benchmark side is joined as a table; Spark broadcasts it
where its size allows that, and else shuffles both sides by the window's hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import save, small, whole_text

WINDOW = 8
#: Share of an item's windows that a document must hold, and of its slots that must be replaced consistently.
COVERAGE, AGREEMENT = 0.5, 0.75
#: Words of a window that must not be names or numbers, for windows that are compared as templates.
LITERAL = 4
#: Windows belong to one occurrence if their distances from the item's places differ by no more from one to the next.
SLACK = 8
#: Units of measure that count as such after a number.
UNITS = ["mm", "cm", "m", "km", "in", "ft", "mi", "mg", "g", "kg", "lb", "oz", "ml", "l", "s", "sec", "seconds", "min", "minutes", "h", "hours", "days", "weeks", "months", "years", "%", "percent", "dollars", "euros", "usd", "eur", "degrees", "meters", "metres", "kilometers", "kilometres", "miles", "feet", "inches", "grams", "kilograms", "pounds", "liters", "litres"]
#: Words of numbers.
NUMBERS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion dozen".split()
#: Words that open sentences and aren't names.
OPENERS = "a an the this that these those there here it he she we you they i my his her its our your their what which who whom whose when where why how is are was were do does did can could will would should may must if then so and but or for to of in on at by with from as after before about under over during since while because although though each every all some any no not only also once first second next last find given suppose let consider compute calculate solve show prove name write say add tell make use".split()
#: Signs that separate words wherever they stand.
SIGNS = "\n\t\r\x0b\x0c\u00a0()[]{}\"'*#&|_<>=~^`“”«»‘’…–—/\\;"
NUM, UNIT, NAME, STOP = "\u0001", "\u0002", "\u0003", "\u0004"
#: Stands for the blank between words of one name or one number.
JOINT = "\u0005"
_NUMBER = "(?:" + "|".join(f"[{w[0]}{w[0].upper()}]{w[1:]}" for w in sorted(NUMBERS, reverse=True)) + ")"
_OPENER = "(?:" + "|".join(w.capitalize() for w in OPENERS) + ")"
#: The blank between two capitalised words that aren't openers, and that between two words of a number.
JOINED = rf" (?=\p{{Lu}}\p{{Ll}}++ )(?!{_OPENER} )(?<=[ \x05]\p{{Lu}}\p{{Ll}}{{1,30}}+ )(?<![ \x05]{_OPENER} )| (?={_NUMBER} )(?<=[ \x05]{_NUMBER} )"


def _once(rows: DataFrame, **columns: Column) -> DataFrame:
    """Columns that later steps use repeatedly: made once, as an exploded array of one isn't merged into what follows."""
    for name, col in columns.items():
        rows = rows.select("*", F.explode(F.array(col)).alias(name))
    return rows


def words_of(text: Column) -> Column:
    """The words as they stand, without punctuation; an end of sentence stays as a word of its own.

    Plain replacements instead of regular expressions, which take most of the time on long texts.
    """
    plain = F.translate(F.concat(text, F.lit(" ")), "!?" + SIGNS, ".." + " " * len(SIGNS))
    for mark, by in ((". ", f" {STOP} "), (", ", " "), (": ", " ")):
        plain = F.replace(plain, F.lit(mark), F.lit(by))
    plain = F.regexp_replace(F.concat(F.lit(f"{STOP} "), plain), JOINED, JOINT)
    return F.filter(F.split(plain, " "), lambda w: w != "")


def _kinds(words: Column, make) -> Column:
    """``make(word, kind)`` for each word but ends of sentences; the kind is the word in lower case or a placeholder."""
    before = F.concat(F.array(F.lit(STOP)), F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))))
    units = F.array(*[F.lit(u) for u in UNITS])

    def number(w: Column) -> Column:
        # the first character decides for most words, without a regular expression
        figures = ((F.ascii(w) <= 57) | (F.ascii(w) == 8364)) & w.rlike(r"^[$€]?[+-]?\d[\d.,:/]*%?$")
        return figures | F.lower(F.substring_index(w, JOINT, 1)).isin(*NUMBERS)

    def one(w: Column, last: Column) -> Column:
        # possessive: else the engine recurses for each word of a name, and a stack that overflows ends the executor
        name = (F.ascii(w).between(65, 90) | (F.ascii(w) >= 192)) & w.rlike(rf"^\p{{Lu}}\p{{Ll}}++(?:{JOINT}\p{{Lu}}\p{{Ll}}++)*+$")
        name = name & ~F.lower(w).isin(*OPENERS)
        kind = F.when(number(w), F.lit(NUM)).when(number(last) & F.array_contains(units, F.lower(w)), F.lit(UNIT)).when(name, F.lit(NAME)).otherwise(F.lower(w))
        return F.when(w != STOP, make(w, kind))

    return F.array_compact(F.zip_with(words, before, one))


def templates(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, x): the template of each text as (word, kind)."""
    words = _once(rows.select(F.col(key).alias("key"), F.col(text).alias("__t")), w=words_of(whole_text("__t")))
    return _once(words, x=_kinds(F.col("w"), lambda w, kind: F.struct(w.alias("word"), kind.alias("kind")))).select("key", "x")


def _elements(rows: DataFrame, key: str, text: str, exact: bool) -> DataFrame:
    """(key, h): a hash for each word of the template, or with ``exact`` of the word itself in lower case."""
    words = _once(rows.select(F.col(key).alias("key"), F.col(text).alias("__t")), w=words_of(whole_text("__t"))).select("key", "w")
    make = (lambda w, kind: F.xxhash64(F.lit("="), F.lower(w))) if exact else (lambda w, kind: F.xxhash64(kind))
    return _once(words, h=_kinds(F.col("w"), make)).select("key", "h")


def _windowed(rows: DataFrame, base: str, sizes: list[int]) -> DataFrame:
    """Columns ``base`` + size for each size: the hashes of all windows of so many elements of the array ``base``.

    Hashes are paired: those of two elements give that of a window of two, those of two such windows that of four, and
    so on; other sizes are put together from these.
    """

    def pair(a: str, b: str, at: int, n: Column) -> Column:
        return F.zip_with(F.slice(a, 1, n), F.slice(b, at + 1, n), lambda x, y: F.xxhash64(x, y))

    length = lambda k: F.greatest(F.size(base) - (k - 1), F.lit(0))
    powers = [1]
    names = {1: base}
    while powers[-1] * 2 <= max(sizes):
        k = powers[-1] * 2
        rows = _once(rows, **{f"{base}{k}": pair(names[k // 2], names[k // 2], k // 2, length(k))})
        names[k] = f"{base}{k}"
        powers.append(k)
    for k in sizes:
        if k in names:
            continue
        parts = [p for p in reversed(powers) if k & p]
        last, have = names[parts[0]], parts[0]
        for p in parts[1:]:
            name = f"{base}{k}_{have + p}" if have + p < k else f"{base}{k}"
            rows = _once(rows, **{name: pair(last, names[p], have, length(have + p))})
            last, have = name, have + p
    return rows


def windows(rows: DataFrame, key: str, text: str, sizes: list[int] | None = None, exact: bool = False) -> DataFrame:
    """(key, size, at, h): the hash of each window of ``sizes`` template words; a text of fewer words has none."""
    sizes = sizes or [WINDOW]
    made = _windowed(_elements(rows, key, text, exact), "h", sizes)
    name = lambda k: "h" if k == 1 else f"h{k}"
    if len(sizes) == 1:
        return made.select("key", F.lit(sizes[0]).alias("size"), F.posexplode(name(sizes[0])).alias("at", "h"))

    def numbered(k: int) -> Column:
        return F.transform(name(k), lambda h, i: F.struct(F.lit(k).alias("size"), i.alias("at"), h.alias("h")))

    each = F.concat(*[numbered(k) for k in sizes])
    return made.select("key", F.explode(each).alias("x")).select("key", "x.*")


def asked(items: DataFrame, item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_id, n, size, item_at, h, exact): the windows that documents are searched for, and each item's number of them."""
    sizes = list(range(2, WINDOW + 1))
    rows = templates(items, item_col, item_text)
    rows = _once(rows, t=F.transform("x", lambda x: F.xxhash64(x["kind"])), e=F.transform("x", lambda x: F.xxhash64(F.lit("="), F.lower(x["word"]))))
    rows = _windowed(_windowed(rows, "t", sizes), "e", sizes)
    own = F.least(F.size("x"), F.lit(WINDOW))

    def one(k: int) -> Column:
        def window(h: Column, i: Column) -> Column:
            literal = F.size(F.filter(F.slice("x", i + 1, k), lambda x: ~x["kind"].isin(NUM, NAME)))
            exact = literal < min(LITERAL, k)
            return F.struct(F.lit(k).alias("size"), i.alias("item_at"), F.when(exact, F.get(f"e{k}", i)).otherwise(h).alias("h"), exact.alias("exact"))

        return F.when(own == k, F.transform(f"t{k}", window))

    each = F.coalesce(*[one(k) for k in sizes])
    return rows.select(F.col("key").alias("item_id"), F.greatest(F.size("x") - (WINDOW - 1), F.lit(1)).alias("n"), F.explode(each).alias("w")).select("item_id", "n", "w.*").distinct()


def matches(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_windows, coverage, n_slots, agreement, contaminated), a row for each pair that shares a window.

    ``n_windows`` counts the item's windows that the document holds, ``coverage`` is their share. Of the item's slots
    that matched windows show, ``n_slots`` is the number of different words and ``agreement`` the share of them that the
    document replaces by one and the same word which stands for no other slot (1 where there are none); both are those
    of the best occurrence. ``contaminated``: an occurrence, or all that the document holds of the item, has enough of
    its windows and slots. An item of a single word is not looked for. Null ids are left out, null texts are empty;
    repeated rows count once. Texts are read whole, whatever their length. Of occurrences that are equally good any may give
    ``n_slots`` and ``agreement``, which are equal then. An empty table on either side gives no rows; other columns, whatever their names, are
    left out.
    """
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), whole_text(text).alias("text"))
    items = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item_id"), whole_text(item_text).alias("text"))
    wanted = save(asked(items), "benchmark")
    # which lengths there are, of either kind: at most twice WINDOW
    kinds = {(r.size, r.exact) for r in wanted.select("size", "exact").distinct().collect()}
    seen = None
    for exact in (False, True):
        sizes = sorted(k for k, x in kinds if x == exact)
        if sizes or not exact:
            part = windows(docs, "doc_id", "text", sizes or [WINDOW], exact)
            seen = part if seen is None else seen.union(part)
    seen = seen.select(F.col("key").alias("doc_id"), F.col("at").alias("doc_at"), "size", "h").join(wanted.select("size", "h").distinct(), ["size", "h"], "left_semi")
    hits = save(seen.join(wanted, ["size", "h"]).select("doc_id", "doc_at", "item_id", "item_at", "n", "size").distinct(), "matches")
    shift = (F.col("doc_at") - F.col("item_at")).alias("shift")
    pair = Window.partitionBy("doc_id", "item_id").orderBy("shift")
    moved = hits.select("doc_id", "item_id", shift).distinct().withColumn("new", F.coalesce((F.col("shift") - F.lag("shift").over(pair) > SLACK).cast("int"), F.lit(1)))
    occurrence = moved.withColumn("nth", F.sum("new").over(pair)).drop("new")
    # each window counts for its occurrence, and for the whole document as number 0
    every = hits.withColumn("shift", shift).join(occurrence, ["doc_id", "item_id", "shift"]).withColumn("nth", F.explode(F.array("nth", F.lit(0).cast("long"))))
    every = save(every, "occurrences")
    found = every.groupBy("doc_id", "item_id", "nth").agg(F.count_distinct("item_at").alias("n_windows"), F.max("n").alias("n"))

    # the slots of the texts that matched at all
    def slots(rows: DataFrame, key: str) -> DataFrame:
        made = templates(rows, key, "text").select(F.col("key").alias(key), F.posexplode("x").alias("place", "x"))
        return made.where(F.col("x.kind").isin(NUM, UNIT, NAME)).select(key, "place", F.col("x.kind").alias("kind"), F.lower("x.word").alias("word")).distinct()

    of_item = slots(items.join(small(hits.select("item_id").distinct()), "item_id", "left_semi"), "item_id")
    of_doc = slots(docs.join(small(hits.select("doc_id").distinct()), "doc_id", "left_semi"), "doc_id")
    shown = every.select("doc_id", "item_id", "nth", "shift", "item_at", "size").join(of_item, "item_id").where((F.col("place") >= F.col("item_at")) & (F.col("place") < F.col("item_at") + F.col("size")))
    shown = shown.select("doc_id", "item_id", "nth", "kind", F.col("word").alias("item_word"), (F.col("place") + F.col("shift")).alias("place")).distinct()
    pairs = shown.join(of_doc, ["doc_id", "place", "kind"]).groupBy("doc_id", "item_id", "nth", "kind", "item_word", "word").agg(F.count(F.lit(1)).alias("c"))
    once = pairs.groupBy("doc_id", "item_id", "nth", "kind", "item_word").agg(F.count(F.lit(1)).alias("k"), F.min("word").alias("word"))
    used = once.groupBy("doc_id", "item_id", "nth", "kind", "word").agg(F.count(F.lit(1)).alias("slots"), F.sum((F.col("k") == 1).cast("int")).alias("single"))
    agreed = used.groupBy("doc_id", "item_id", "nth").agg(F.sum("slots").alias("n_slots"), F.sum(F.when(F.col("slots") == 1, F.col("single")).otherwise(0)).alias("good"))
    joined = found.join(agreed, ["doc_id", "item_id", "nth"], "left").withColumn("n_slots", F.coalesce("n_slots", F.lit(0)).cast("long"))
    coverage, agreement = F.col("n_windows") / F.col("n"), F.when(F.col("n_slots") > 0, F.col("good") / F.col("n_slots")).otherwise(F.lit(1.0))
    made = joined.withColumn("coverage", F.round(coverage, 6)).withColumn("agreement", F.round(agreement, 6))
    made = made.withColumn("bad", (F.col("coverage") >= COVERAGE) & (F.col("agreement") >= AGREEMENT))
    whole = F.col("nth") == 0
    best = F.max_by(F.struct("n_slots", "agreement"), F.struct("bad", "coverage", "agreement", "n_slots"))
    out = made.groupBy("doc_id", "item_id").agg(F.max(F.when(whole, F.col("n_windows"))).alias("n_windows"), F.max(F.when(whole, F.col("coverage"))).alias("coverage"), best.alias("b"), F.bool_or("bad").alias("contaminated"))
    return out.select("doc_id", "item_id", "n_windows", "coverage", "b.n_slots", "b.agreement", "contaminated")


def decontaminate(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **how) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; rows with a null id stay."""
    bad = save(matches(docs, items, id_col=id_col, **how).where("contaminated").select(F.col("doc_id").alias("__bad")).distinct(), "contaminated")
    return docs.join(small(bad), F.col(id_col) == F.col("__bad"), "left_anti")
