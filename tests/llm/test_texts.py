"""Decontamination, WARC records and the pipeline."""

import base64
import hashlib
from collections import Counter, defaultdict

import pytest

from rollbook.llm import decontaminate, queries, warc

from ..conftest import SMALL

ITEM = "A farmer named Keller has 24 apples and sells 7 kg of them to his neighbour Brandt for 3 dollars before the market closes in the evening today."
OTHER = ITEM.replace("Keller", "Moreau").replace("24", "95").replace("7 kg", "12 lb").replace("Brandt", "Silva").replace("3 dollars", "18 euros")
MIXED = OTHER.replace("Silva", "Moreau")
CLEAN = "The river froze early that year and nobody could remember a winter when the mills had stopped so long before the feast of lights began."


def template(text):
    """(kind, word) of each word, plainly."""
    text = (text or "") + " "
    for c in "!?":
        text = text.replace(c, ".")
    for c in decontaminate.SIGNS:
        text = text.replace(c, " ")
    text = text.replace(". ", f" {decontaminate.STOP} ").replace(", ", " ").replace(": ", " ")
    import re

    capital = lambda w: len(w) > 1 and w[0].isupper() and w[1:].isalpha() and w[1:].islower() and w.lower() not in decontaminate.OPENERS
    word_number = lambda w: w.lower() in decontaminate.NUMBERS and w[1:].islower()
    words = []
    for w in filter(None, text.split(" ")):
        # a word goes on with the name or number before it
        same = words and any(f(w) and f(words[-1].split(decontaminate.JOINT)[-1]) for f in (capital, word_number))
        words = [*words[:-1], f"{words[-1]}{decontaminate.JOINT}{w}"] if same else [*words, w]
    number = lambda w: bool(re.match(r"^[$€]?[+-]?\d[\d.,:/]*%?$", w)) or w.split(decontaminate.JOINT)[0].lower() in decontaminate.NUMBERS
    out, last = [], decontaminate.STOP
    for w in words:
        if w != decontaminate.STOP:
            if number(w):
                kind = "#num"
            elif number(last) and w.lower() in decontaminate.UNITS:
                kind = "#unit"
            elif all(map(capital, w.split(decontaminate.JOINT))):
                kind = "#name"
            else:
                kind = w.lower()
            out.append((kind, w))
        last = w
    return out


def grams(text, n):
    """Windows of n words: as templates, or word by word where there are too few that aren't placeholders."""
    t = template(text)
    out = []
    for i in range(len(t) - n + 1):
        part = t[i : i + n]
        literal = sum(k not in ("#num", "#name") for k, _ in part)
        out.append(tuple(k for k, _ in part) if literal >= min(decontaminate.LITERAL, n) else ("=", *(w.lower() for _, w in part)))
    return out


def shared(docs, items):
    """(doc, item) -> (windows of the item that the document holds, coverage)."""
    asked = defaultdict(list)
    for i, t in items:
        size = min(len(template(t)), decontaminate.WINDOW)
        g = grams(t, size) if size > 1 else []
        for at, w in enumerate(g):
            asked[w].append((i, at, len(g)))
    sizes = {len(w) - (w[0] == "=") for w in asked}
    out = defaultdict(set)
    for d, t in docs:
        for w in {w for n in sizes for w in grams(t, n)}:
            for i, at, n in asked.get(w, []):
                out[d, i, n].add(at)
    return {(d, i): (len(x), round(len(x) / n, 6)) for (d, i, n), x in out.items()}


def test_windows_are_those_of_the_definition(spark, small):
    docs, items = (small(n).collect() for n in ("documents", "benchmark"))
    want = shared([(r.doc_id, r.text) for r in docs], [(r.item_id, r.text) for r in items])
    rows = queries.op3_decontamination(spark, SMALL).collect()
    assert {(r.doc_id, r.item_id): (r.n_windows, r.coverage) for r in rows} == want
    assert any(r.contaminated for r in rows)


def test_short_and_dense_items_are_found_inside_documents(spark):
    short = ["What is 12 plus 7?", "Maria bought 5 apples for 3 dollars.", "Blue whales", "seven red kites", "who wrote that old book", "name a river in Peru now"]
    dense = "Add 12 34 56 78 90 11 13 17 and 19 to Berlin Paris Rome Oslo"
    items = [(k, t) for k, t in enumerate([*short, dense, "word", "", None])]
    docs = [(k, f"{CLEAN} {t} {CLEAN}") for k, t in enumerate([*short, dense])]
    docs += [(50, f"{CLEAN} Maria bought 9 apples for 4 euros. {CLEAN}"), (51, f"{CLEAN} What is 13 plus 7? {CLEAN}"), (52, f"{CLEAN} {dense.replace('34', '35').replace('Rome', 'Bonn').replace('90', '91')}"), (53, CLEAN)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    rows = decontaminate.matches(d, i).collect()
    want = shared(docs, [x for x in items if x[1]])
    assert {(r.doc_id, r.item_id): (r.n_windows, r.coverage) for r in rows} == want
    # sums with other numbers are other questions where hardly a word is left to tell
    assert {(r.doc_id, r.item_id) for r in rows if r.contaminated} == {(k, k) for k in range(7)} | {(50, 1)}


def test_names_and_numbers_of_any_words_are_one_slot(spark):
    """A name that opens a sentence, names and numbers of several words: the same question with others in it."""
    item = "Alice has 5 apples in 2 bags. Then John Smith takes a train from Paris to Rome that leaves at noon."
    others = [
        "Maria has 7 apples in 3 bags. Then Pedro takes a train from New York to Los Angeles that leaves at noon.",
        "Mary Ann has twenty five apples in two bags. Then Jean Luc Martin takes a train from Oslo to Kyoto that leaves at noon.",
        "Oslo What", "The train from Oslo to Kyoto leaves Mary Ann at noon, and nobody has apples.",
    ]
    docs = [(k, f"{CLEAN} {t} {CLEAN}") for k, t in enumerate(others)]
    rows = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item), (2, "Alice has 5 apples in 2 bags.")], "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id): (r.coverage, r.agreement, r.contaminated) for r in rows} == {(d, i): (1.0, 1.0, True) for d in (0, 1) for i in (1, 2)}
    assert {(r.doc_id, r.item_id): r.n_slots for r in rows} == {(0, 1): 6, (1, 1): 6, (0, 2): 3, (1, 2): 3}


def test_a_name_of_thousands_of_words_needs_no_deeper_stack(spark):
    """Capitalised words without an end: one name, whose pattern must not recurse for each word."""
    item = "Nobody ever saw the river freeze before the long winter came to the old town of Paris that year."
    docs = [(1, " ".join(["Alpha", "Bravo", "Carlo"] * 3_000)), (2, f"{CLEAN} {item.replace('Paris', 'Oslo ' * 5_000)} {CLEAN}")]
    rows = decontaminate.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert [(r.doc_id, r.item_id, r.coverage, r.contaminated) for r in rows] == [(2, 1, 1.0, True)]


def slots_of(doc, item):
    """Slots and agreement of the whole document's matches, plainly."""
    a, b = template(item), template(doc)
    n = decontaminate.WINDOW
    seen = defaultdict(set)
    for i, w in enumerate(grams(item, n)):
        for j, v in enumerate(grams(doc, n)):
            if w == v:
                for k in range(n):
                    kind, word = a[i + k]
                    if kind.startswith("#") and len(kind) > 1:
                        seen[kind, word.lower()].add(b[j + k][1].lower())
    stands = Counter((k, min(v)) for (k, _), v in seen.items())
    good = sum(len(v) == 1 and stands[k, min(v)] == 1 for (k, _), v in seen.items())
    return len(seen), round(good / len(seen), 6)


def test_slots_are_those_of_the_definition(spark):
    import random

    rng = random.Random(8)
    names, numbers, units = ["Keller", "Moreau", "Brandt", "Silva", "Rossi"], ["24", "95", "7", "12", "3"], ["kg", "lb", "km"]
    texts = []
    for k in range(40):
        words = ITEM.split()
        for j, w in enumerate(words):
            for group in (names, numbers, units):
                if w in group and rng.random() < 0.5:
                    words[j] = rng.choice(group)
        texts.append((k, " ".join(words)))
    rows = decontaminate.matches(spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()
    assert len(rows) == len(texts)
    for r in rows:
        slots, agreement = slots_of(dict(texts)[r.doc_id], ITEM)
        assert (r.n_slots, r.agreement) == (slots, agreement) and r.contaminated == (r.coverage >= 0.5 and agreement >= 0.75)
    assert len({r.contaminated for r in rows}) == 2


def test_reparameterised_items_are_found_and_inconsistent_ones_are_not(spark):
    around = lambda t: f"{CLEAN} {t} {CLEAN}"
    docs = spark.createDataFrame([(1, around(ITEM)), (2, around(OTHER)), (3, CLEAN), (4, None), (5, ""), (6, around(OTHER)), (None, ITEM), (6, around(OTHER)), (7, ITEM[: len(ITEM) // 4])], "doc_id long, text string")
    docs = docs.selectExpr("*", "1 AS h", "'x' AS n", "2 AS key", "3 AS item_id", "true AS contaminated")
    items = spark.createDataFrame([(10, ITEM), (11, None), (12, ""), (None, ITEM), (10, ITEM)], "item_id long, text string")
    rows = {(r.doc_id, r.item_id): r for r in decontaminate.matches(docs, items).collect()}
    assert {d for (d, _), r in rows.items() if r.contaminated} == {1, 2, 6}
    assert rows[1, 10].coverage == rows[2, 10].coverage == 1 and rows[2, 10].agreement == 1 and rows[2, 10].n_slots == 7
    left = decontaminate.decontaminate(docs, items)
    assert left.columns == docs.columns and sorted(r.doc_id or 0 for r in left.collect()) == [0, 3, 4, 5, 7]
    twice = spark.createDataFrame([(1, " ".join([ITEM, MIXED]))], "doc_id long, text string")
    both = decontaminate.matches(twice, items.where("item_id = 10")).collect()[0]
    assert both.agreement == 1 and both.contaminated  # the copy isn't excused by the variant after it
    mixed = decontaminate.matches(spark.createDataFrame([(1, f"{CLEAN} {MIXED}")], "doc_id long, text string"), items.where("item_id = 10")).collect()[0]
    assert mixed.agreement < 0.75 and not mixed.contaminated
    assert decontaminate.matches(docs.where("false"), items).count() == 0 and decontaminate.matches(docs, items.where("false")).count() == 0


def test_no_python_on_the_main_path(spark, small):
    found = decontaminate.matches(small("documents"), small("benchmark"))
    for made in (decontaminate.windows(small("documents"), "doc_id", "text"), decontaminate.asked(small("benchmark")), found):
        plan = made._jdf.queryExecution().toString()
        assert "Python" not in plan and "Arrow" not in plan


def parse(data):
    """Records of a WARC file: (headers, block)."""
    out, at = [], 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        headers = [tuple(x.split(": ", 1)) for x in lines[1:]]
        n = int(dict(headers)["Content-Length"])
        out.append((dict(headers), data[end + 4 : end + 4 + n]))
        assert data[end + 4 + n : end + 8 + n] == b"\r\n\r\n"
        at = end + 8 + n
    return out


def sha1(b):
    return "sha1:" + base64.b32encode(hashlib.sha1(b).digest()).decode()


def plainly(page):
    """The text of a page by the library's parser."""
    from html.parser import HTMLParser

    class Text(HTMLParser):
        out, skip = "", 0

        def handle_starttag(self, tag, attrs):
            self.skip += tag in warc.SILENT
            self.out += "\n" * (tag in warc.BREAKS)

        def handle_endtag(self, tag):
            self.skip -= tag in warc.SILENT and self.skip > 0
            self.out += "\n" * (tag in warc.BREAKS)

        def handle_data(self, data):
            self.out += data * (not self.skip)

    made = Text(convert_charrefs=True)
    made.feed(page)
    made.close()
    return [" ".join(x.split()) for x in made.out.split("\n") if x.split()]


@pytest.mark.parametrize("version", ["1.0", "1.1"])
def test_warc_versions(spark, new_folder, version):
    block = f"about WARC/{version} and WARC/1.9\r\n".encode()
    record = f"WARC/{version}\r\nWARC-Type: warcinfo\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"
    with open(f"{new_folder}/a.warc", "wb") as out:
        out.write(record * 6)
    assert [bytes(r.block) for r in warc.read(spark, f"file://{new_folder}/a.warc").collect()] == [block] * 6
    for name, data in (("other", b"WARC/0.17\r\nContent-Length: 1\r\n\r\nx"), ("torn", record + b"more\r\n"), ("empty", b"")):
        with open(f"{new_folder}/{name}.warc", "wb") as out:
            out.write(data)
    assert warc.read(spark, f"file://{new_folder}/empty.warc").count() == 0
    with pytest.raises(Exception, match="no WARC 1.0 or 1.1 record"):
        warc.read(spark, f"file://{new_folder}/other.warc").count()


@pytest.mark.parametrize("compression", [None, "gzip"])
def test_warc_files_read_back(spark, small, new_folder, compression):
    import glob

    pages = {r.page_id: r for r in small("pages").collect()}
    warc.write(warc.responses(small("pages"), date="2024-05-06T07:08:09Z"), f"file://{new_folder}/in", compression)
    rows = warc.derive(warc.read(spark, f"file://{new_folder}/in"))
    warc.write(rows, f"file://{new_folder}/w")
    found = [x for f in glob.glob(f"{new_folder}/w/part-*") for x in parse(open(f, "rb").read())]
    assert len(found) == 2 * len(pages)
    by_id = {h["WARC-Record-ID"]: (h, b) for h, b in found}
    assert len(by_id) == len(found)
    for r in rows.collect():
        h, block = by_id[r.record_id]
        page = pages[int(r.page_id)]
        payload = (page.html or "").encode()
        assert h["WARC-Refers-To"] == r.refers_to and h["WARC-Type"] == r.type and h["WARC-Target-URI"] == h["WARC-Refers-To-Target-URI"] == page.url
        assert h["WARC-Refers-To-Date"] == "2024-05-06T07:08:09Z"
        assert h["WARC-Block-Digest"] == sha1(block) == r.block_digest and r.payload_digest == sha1(payload)
        if r.type == "conversion":
            assert [" ".join(x.split()) for x in block.decode().split("\n") if x.split()] == plainly(page.html or "")
        else:
            fields = dict(x.split(": ", 1) for x in block.decode().splitlines() if ": " in x)
            assert by_id[fields["conversion-record"]][0]["WARC-Refers-To"] == r.refers_to == fields["source-warc-record-id"]
            assert fields["http-content-type"].startswith("text/html") and fields["http-status"] == "HTTP/1.1 200 OK"
            assert fields["source-payload-digest"] == sha1(payload) and int(fields["http-content-length"]) == len(payload)


def test_warc_records_of_others(spark, new_folder):
    """Headers, digests, character sets and codings as a crawler writes them, record by record compressed; and blocks that hold the records' first line."""
    import gzip

    def made(kind, number, block, **more):
        head = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:uuid:{number}>", "WARC-Date": "2020-01-02T03:04:05Z", "WARC-Target-URI": f"http://h/{number}"} | more
        return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head.items()) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"

    http = b"HTTP/1.1 404 Not Found\r\nContent-Type: text/html; charset=iso-8859-1\r\nX-Long: a\r\n b\r\n\r\n"
    packed = gzip.compress("<p>packed é</p>".encode())
    tricky = b"<p>one</p>\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nno WARC/1.1\r\n<p>two</p>"
    records = [made("warcinfo", 0, b"software: x\r\n"), made("response", 1, http + "<title>Caf\u00e9</title><a href='/x'>l</a>".encode("latin-1"), **{"WARC-Payload-Digest": "sha1:STATED"}), made("request", 2, b"GET / HTTP/1.1\r\n\r\n"),
               made("response", 3, b"HTTP/1.1 200 OK\r\nContent-Encoding: gzip\r\n\r\n" + packed), made("response", 4, b"HTTP/1.1 200 OK\r\n\r\n" + tricky), made("response", 5, b"")]
    for name, data in (("a.warc", b"".join(records)), ("b.warc.gz", b"".join(map(gzip.compress, records)))):
        with open(f"{new_folder}/{name}", "wb") as out:
            out.write(data)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for name, split in (("a.warc", 1 << 20), ("b.warc.gz", 1 << 20), ("a.warc", 700), ("a.warc", 300), ("a.warc", 64)):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            rows = {(r.refers_to, r.type): r for r in warc.derive(warc.read(spark, f"file://{new_folder}/{name}")).collect()}
            assert {k[10:-1] for k, _ in rows} == {"1", "3", "4", "5"} and len(rows) == 8, (name, split)
            text = {k[10:-1]: parse(r.record + b"\r\n\r\n")[0][1].decode() for (k, t), r in rows.items() if t == "conversion"}
            assert text["1"] == "Caf\u00e9\nl" and text["3"] == "packed \u00e9" and text["5"] == ""
            assert text["4"].split() == "one WARC/1.1 WARC-Type: response Content-Length: 3 no WARC/1.1 two".split()
            about = parse(rows["<urn:uuid:1>", "metadata"].record + b"\r\n\r\n")[0][1].decode().splitlines()
            assert "source-payload-digest: sha1:STATED" in about and "http-status: HTTP/1.1 404 Not Found" in about and "http-x-long: a b" in about and "outlink: /x" in about and "title: Caf\u00e9" in about
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_warc_of_odd_rows(spark, new_folder):
    rows = [(1, None, None), (2, "http://a/\r\nX: y", "<p>a<script>no</script>b</p>"), (2, "http://a/", ""), (None, "u", "<title>T</title>&amp; é"), (3, "u", "<p>x</p>" * 50_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS record_id", "'d' AS date", "2 AS payload", "'c' AS record")
    warc.write(warc.responses(pages), f"file://{new_folder}/in")
    made = warc.derive(warc.read(spark, f"file://{new_folder}/in")).collect()
    assert len(made) == 10 and Counter(r.type for r in made) == {"metadata": 5, "conversion": 5}
    assert all(b"\r\nX: y" not in r.record.split(b"\r\n\r\n")[0] for r in made)
    assert warc.derive(spark.createDataFrame([(None, None)], "headers string, block binary")).count() == 0
    assert warc.responses(pages.where("false")).count() == 0


@pytest.mark.parametrize("part", ["<script>", "<!--", "<a ", "<html ", "<", "<a href='", "<title>", "</script", "&", "<p", "a<b "])
def test_pages_without_ends_take_no_longer(part):
    import time

    began = time.perf_counter()
    warc.scanned(part * (2_000_000 // len(part)))
    assert time.perf_counter() - began < 5
    assert warc.plain_text("<p>a<script>no</script>b</p>c 1 < 2") == "ab\nc 1 < 2"


def cut_words(texts, n=51):
    """Words that are left where each run of n words that starts anywhere else as well is gone."""
    lists = [(t or "").split() for t in texts]
    seen = Counter(tuple(w[i : i + n]) for w in lists for i in range(len(w) - n + 1))
    out = []
    for w in lists:
        gone = [False] * len(w)
        for i in range(len(w) - n + 1):
            if seen[tuple(w[i : i + n])] > 1:
                gone[i : i + n] = [True] * n
        out.append([x for x, g in zip(w, gone, strict=True) if not g])
    return out


def test_pipeline(spark, small, path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from .test_duplicates import roots
    from .test_stages import similar

    docs = small("documents").cache()
    texts = {r.doc_id: r.text for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "simhash", "suffix", "decontamination", "packing"]
    kept = stages["toxicity"](spark, docs, SMALL)
    assert kept.columns == docs.columns and 0 < kept.count() <= len(texts)
    # what each stage ought to leave, from what the first one keeps
    ids = sorted(r.doc_id for r in kept.collect())
    own = roots(len(ids), similar([texts[i] for i in ids]))
    ids = [i for k, i in enumerate(ids) if own[k] == k]
    words = dict(zip(ids, cut_words([texts[i] for i in ids]), strict=True))
    left = {i: w for i, w in words.items() if w or not (texts[i] or "").split()}
    assert any(len(w) < len((texts[i] or "").split()) for i, w in words.items())
    have = stages["suffix"](spark, docs.where(docs.doc_id.isin(ids)), SMALL)
    assert have.columns == docs.columns
    have = {r.doc_id: r for r in have.collect()}
    assert {i: (r.text or "").split() for i, r in have.items()} == left
    assert all(r.n_chars == len(r.text) for r in have.values() if r.text is not None)
    rows = spark.createDataFrame([(i, r.text) for i, r in have.items()], "doc_id long, text string")
    bad = {r.doc_id for r in decontaminate.matches(rows, small("benchmark")).where("contaminated").collect()}
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(have) - bad and bad
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, n in sorted(s):
            assert offset == at
            at += n
        assert at <= 4096


def test_stages_of_odd_rows(spark, odd, nothing):
    """Each stage keeps the columns of documents, whatever others there are, and an empty table stays empty."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, nothing, SMALL).count() == 0
        made = stage(spark, odd, SMALL)
        rows = made.collect()
        assert rows and (name == "packing" or made.columns == corpus_pipeline.COLUMNS)
