"""Token files, flat files and packing against the tokenizers library."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rollbook.llm import packing, queries, separators, token_files
from rollbook.llm.tokens import tokenizer

from ..conftest import SMALL


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60) | st.text(alphabet="aB9é .,'<|>_-\n\t数ß", max_size=40))
def test_remembered_pieces_are_the_library_s(text):
    path = queries.tokenizer_path()
    made = tokenizer(path)
    want = np.array(made.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert made.encode([text]) == [want]
    assert made.encode([text, text + " x"])[0] == want


def test_remembered_pieces_take_bounded_memory(path):
    """Of a million different words a worker keeps what takes under 80 MB."""
    import sys

    from rollbook.llm.tokens import WordTokenizer

    made = WordTokenizer(path)
    made._ids_of = lambda pieces: {x: b"\1\0" for x in pieces}
    for at in range(0, 1_000_000, 50_000):
        words = ["".join(chr(97 + k // 26**j % 26) for j in range(5)) for k in range(at, at + 50_000)]
        assert made.encode([" ".join(words)]) == [np.ones(50_000, "<u4").tobytes()]
    assert sys.getsizeof(made.known) + sum(sys.getsizeof(x) + sys.getsizeof(y) for x, y in made.known.items()) < 80e6


def test_texts_of_known_pieces_cost_less_than_cutting_them_by_a_pattern(path):
    import re
    import time

    words = ["".join(chr(97 + k // 26**j % 26) for j in range(3)) for k in range(2_000)]
    texts = [" ".join(words[k:] + words[:k]) for k in range(0, 500)]
    made = tokenizer(path)
    want = made.encode(texts)
    pattern = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
    known = dict.fromkeys(words, b"\1\0")
    ours, pattern_s = [], []
    for _ in range(3):
        began = time.process_time()
        assert made.encode(texts) == want
        ours.append(time.process_time() - began)
        began = time.process_time()
        for t in texts:
            b"".join(map(known.__getitem__, pattern.findall(t.lower())))
        pattern_s.append(time.process_time() - began)
    assert min(ours) < 0.8 * min(pattern_s)


@pytest.mark.parametrize("texts", [[], [""], ["", " \n"], ["", "é", "数", ""], ["1", "12é3", "É«a»", "x_y’s"], ["a<b", "", "don't", "ab"]])
def test_groups_of_odd_texts(path, encode, texts):
    assert tokenizer(path).encode(texts) == [np.array(encode(t), "<u4").tobytes() for t in texts]


def test_packing_runs_one_python_worker_a_task(spark, small, path, monkeypatch):
    plans = []

    def noted(df, name, save=packing.save):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(packing, "save", noted)
    packing.pack(packing.digest(packing.cut_documents(small("documents"), path, end_id=1))).count()
    assert plans and all(p.count("MapInArrow") <= 1 for p in plans)


def test_token_files(spark, small, encode):
    docs = {r.doc_id: r.text for r in small("documents").select("doc_id", "text").collect()}
    start = 0
    have = {r.doc_id: r for r in queries.op1_token_files(spark, SMALL).collect()}
    assert len(have) == len(docs)
    for d in sorted(docs):
        ids = [*encode(docs[d]), 2]
        assert (have[d].start, have[d].n_tokens, have[d].ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)


@pytest.mark.parametrize("delta", [False, True])
def test_token_files_read_back(spark, odd, nothing, path, encode, delta):
    rows = token_files.written(odd, path, end_id=2, delta=delta).collect()
    assert Counter((r.doc_id, tuple(r.tokens)) for r in rows) == Counter((r.doc_id, (*encode(r.text), 2)) for r in odd.collect())
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id or 0 for r in ordered] == sorted(r.doc_id or 0 for r in ordered)
    assert [r.start for r in ordered] == [0, *np.cumsum([r.n_tokens for r in ordered])[:-1]]
    assert token_files.checksums(token_files.written(nothing, path, end_id=2)).count() == 0


def test_token_files_allow_selective_reads(spark, small, path, new_folder):
    import pyarrow.parquet as pq

    at = f"{new_folder}/ids"
    token_files.write(small("documents"), f"file://{at}", path, end_id=2)
    import glob

    for f in glob.glob(f"{at}/*.parquet"):
        meta = pq.ParquetFile(f).metadata
        column = next(meta.row_group(0).column(k) for k in range(meta.num_columns) if meta.row_group(0).column(k).path_in_schema.startswith("tokens"))
        assert column.has_offset_index and column.has_column_index
        assert any("DICTIONARY" in e for e in column.encodings)
    plan = spark.read.parquet(f"file://{at}").where("doc_id = 3").select("doc_id", "n_tokens")._jdf.queryExecution().toString()
    assert ",tokens:" not in plan.split("ReadSchema")[-1] and "EqualTo(doc_id,3)" in plan


def test_separator_scan(spark, small, encode, odd, nothing, path, new_folder):
    have = {r.doc_id: r.n_tokens for r in queries.op4_separator_scan(spark, SMALL).collect()}
    assert have == {r.doc_id: len(encode(r.text)) + 1 for r in small("documents").collect()}
    at = f"file://{new_folder}/odd"
    separators.write(odd, at, path, end_id=queries.SEPARATOR)
    want = Counter((r.doc_id, len(encode(r.text)) + 1) for r in odd.collect() if r.doc_id is not None)
    for block in (1 << 19, 5_000):
        assert Counter((r.doc_id, r.n_tokens) for r in separators.counts(spark, at, end_id=queries.SEPARATOR, block_tokens=block).collect()) == want
    separators.write(nothing, f"file://{new_folder}/none", path, end_id=queries.SEPARATOR)
    assert separators.counts(spark, f"file://{new_folder}/none", end_id=queries.SEPARATOR).count() == 0


@pytest.mark.parametrize(("tokens", "block"), [([], 3), ([5], 1), ([0, 0, 0], 1), ([1, 2, 3, 0, 4, 5, 0, 0, 6], 3), ([9] * 40 + [0] + [8] * 40, 16), ([0] + [3] * 17, 1000)])
def test_scan_of_any_file(spark, new_folder, tokens, block):
    np.array(tokens, "<u2").tofile(f"{new_folder}/x.bin")
    have = sorted((r.start, r.n_tokens, r.ended) for r in separators.scan(spark, f"file://{new_folder}", end_id=0, block_tokens=block).collect())
    want, start = [], 0
    for k, t in enumerate(tokens):
        if t == 0:
            want.append((start, k + 1 - start, True))
            start = k + 1
    if start < len(tokens):
        want.append((start, len(tokens) - start, False))
    assert have == want


def placed(rows, capacity=4096):
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences)


def test_packing(spark, small, encode):
    rows = queries.op6_packing(spark, SMALL).collect()
    want = []
    for r in small("documents").collect():
        ids = [*encode(r.text), 1]
        want += [(r.doc_id, k, a, len(ids[a : a + 4096]), crc(ids[a : a + 4096])) for k, a in enumerate(range(0, len(ids), 4096))]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    total = sum(r.length for r in rows)
    assert placed(rows) <= -(-total // 4096) * 1.02 + 1


def test_packing_of_odd_rows(spark, odd, nothing, path):
    pieces = packing.cut_documents(odd, path, end_id=1)
    rows = packing.pack(packing.digest(pieces).selectExpr("*", "'x' AS sequence_id", "3 AS __nth")).collect()
    assert len(rows) == pieces.count() and placed(rows)
    assert packing.pack(packing.digest(packing.cut_documents(nothing, path, end_id=1))).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_plans_place_every_piece(lengths):
    plan = packing.Plan(dict(Counter(lengths)), 50)
    assert Counter(k for _, times, group in plan.groups for k in group for _ in range(times)) == Counter(lengths)
    assert all(sum(group) <= 50 for _, _, group in plan.groups)
    # best fit decreasing never opens more than 11/9 of the least number
    assert plan.sequences <= 11 / 9 * max(-(-sum(lengths) // 50), sum(1 for k in lengths if k > 25)) * 1.5 + 1


def test_exact_complements_are_used():
    plan = packing.Plan({40: 2, 10: 1, 4: 1, 6: 1, 20: 3, 30: 1, 15: 2}, 50)
    assert all(sum(group) == 50 for _, _, group in plan.groups[:-1]) and plan.sequences == 5


def test_token_file_starts_do_not_hang_on_files(spark, small, path, encode):
    """Several files a part, whose names don't come in order."""
    spark.conf.set("spark.sql.files.maxRecordsPerFile", "7")
    try:
        rows = token_files.written(small("documents"), path, end_id=2).orderBy("doc_id").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")
    start = 0
    for r in rows:
        assert r.start == start and r.n_tokens == len(r.tokens)
        start += r.n_tokens


def test_flat_files_refuse_ids_that_do_not_fit(spark, new_folder):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a"), (2, "b <|endoftext|>")], "doc_id long, text string")
    with pytest.raises(Exception, match="don't fit files of two bytes"):
        separators.write(docs, f"file://{new_folder}/flat", public_tokenizers.path("byte_bpe_50k.json"), end_id=7)
