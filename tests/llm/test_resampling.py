"""Importance resampling against its SQL, a plain selection, and odd rows."""

import hashlib
import math
import random

import numpy as np
import pytest

from rollbook.llm import queries, resampling


def test_query_equals_its_sql(same):
    same(queries.op12_resampling, queries.OP12)


def test_words_are_those_of_the_pattern():
    import re

    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice("aZz09 _-@[`{\x7féK\n\t.　") for _ in range(40))
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        assert [w.decode() for w in resampling.words(text.encode())] == re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def test_longer_runs():
    assert resampling.features(b"A b, c", 2) == ([b"a", b"b", b"c", b"a b", b"b c"], 3)


@pytest.mark.parametrize("spread", [1, 40, 10_000])
def test_the_cut_is_that_of_sorting(spark, monkeypatch, spread):
    monkeypatch.setattr(resampling, "CHUNK", 50)
    rng = random.Random(spread)
    keys = [(rng.randrange(-spread, spread), k // 2) for k in range(900)]
    frame = spark.createDataFrame(keys, "score long, doc_id long").repartition(7)
    order = sorted(keys, key=lambda x: (-x[0], x[1]))
    for k in (1, 2, 90, 450, 899, 900):
        assert resampling.cutoff(frame, k) == order[k - 1]
    assert resampling.cutoff(frame, 0) is None and resampling.cutoff(frame, 901) is None


def test_one_key_may_hold_most_rows(spark):
    text = "word " * 30
    rows = [(None, text)] * 60 + [(k, text + f"x{k}") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    made = resampling.resample(docs, spark.createDataFrame([(1, "word")], "item_id long, text string"), percent=50).collect()
    assert sorted(r.rank for r in made if r["rank"]) == list(range(1, 51)) and len(made) == 100
    drawn = sorted((r for r in made if r["rank"]), key=lambda r: r["rank"])
    assert [r.score for r in drawn] == sorted((r.score for r in made), reverse=True)[:50]


def test_odd_rows(spark, odd, nothing, small):
    have = resampling.resample(odd, small("benchmark"), percent=100, least_words=1).collect()
    assert len(have) == odd.count()
    by = {r.doc_id: r for r in have}
    assert by[1].n_features == by[2].n_features == by[3].n_features == 0 and by[1].weight == 0 and by[1]["rank"] is None
    assert by[6].n_features > 100_000
    h = int(hashlib.sha256(b"2024:1").hexdigest()[:8], 16)
    assert by[1].score == math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
    assert resampling.resample(nothing, small("benchmark")).count() == 0
    empty = small("benchmark").limit(0)
    gain = resampling.gains(resampling.bucket_counts(odd), resampling.bucket_counts(empty))
    assert (gain == resampling.gains(resampling.bucket_counts(odd), np.zeros(10_000, np.int64))).all()
    assert resampling.resample(odd, empty).count() == odd.count()
