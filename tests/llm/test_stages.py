"""The pipeline's stages where they are held to more than the operators' contracts."""

import random

import pytest

import corpus_pipeline
from rollbook.llm import simhash

from ..conftest import SMALL
from .test_duplicates import roots


def runs(text, size=5):
    words = (text or "").lower().split()
    k = min(size, len(words))
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if words else set()


def similar(texts):
    sets = [runs(t) for t in texts]
    for k, a in enumerate(sets):
        for j in range(k + 1, len(sets)):
            common = len(a & sets[j])
            if a == sets[j] or 5 * common >= 4 * (len(a) + len(sets[j]) - common):
                yield k, j


@pytest.mark.parametrize("planted", [False, True])
def test_near_copies_are_those_of_five_words(spark, small, planted):
    if planted:
        rng = random.Random(4)
        texts = []
        for _ in range(25):
            words = [f"w{rng.randrange(5_000)}" for _ in range(rng.randint(60, 300))]
            for _ in range(4):
                at = rng.randrange(len(words))
                n = rng.randint(0, len(words) // 8)
                texts.append(" ".join(words[:at] + [f"x{rng.randrange(5_000)}" for _ in range(n)] + words[at + n :]))
        docs = spark.createDataFrame([(k, t, None, None, len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    else:
        docs = small("documents")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    own = roots(len(rows), similar([t for _, t in rows]))
    kept = sorted(r.doc_id for r in dict(corpus_pipeline.STAGES)["simhash"](spark, docs, SMALL).collect())
    assert kept == [d for k, (d, _) in enumerate(rows) if own[k] == k]


def test_near_copies_of_odd_rows(spark, odd, nothing):
    kept = simhash.deduplicate_similar(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # 8 is there twice with different texts, and both stay
    assert sorted(i for i in ids if i) == [1, 4, 5, 6, 7, 8, 8, 9] and ids.count(None) == 2
    assert simhash.deduplicate_similar(nothing).count() == 0 and simhash.similar(nothing).count() == 0


@pytest.mark.parametrize("how", [simhash.deduplicate, simhash.deduplicate_similar])
def test_texts_that_share_an_id_are_judged_each_by_itself(spark, how):
    a, b, c = ("".join(f"{w}{k} " for k in range(40)) for w in ("ant", "bee", "cat"))
    rows = [(1, a, "x"), (1, b, "x"), (1, b, "x"), (2, a, "y"), (3, c, "z"), (0, c, "z")]
    kept = how(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted([(1, a), (1, b), (0, c)])


def test_passages_of_over_50_words_are_cut_however_short(spark):
    rng = random.Random(6)
    some = lambda n: " ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(3, 8))) for _ in range(n))
    tiny, short, fifty, long = " ".join("abcdefghijklmnopqrstuvwxyz"[k % 26] for k in range(51)), some(51), some(50), some(90)
    assert len(short.encode()) < 400 and len(fifty.encode()) < 400 < len(long.encode())
    parts = [(some(20), p, some(30)) for p in (tiny, short, fifty, long) for _ in range(2)]
    # the words are the passage, not what is between them
    parts[3] = (parts[3][0], short.replace(" ", "\n", 7), parts[3][2])
    rows = [(k, " ".join(p), None, None, 0) for k, p in enumerate(parts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    have = {r.doc_id: r.text for r in dict(corpus_pipeline.STAGES)["suffix"](spark, docs, SMALL).collect()}
    for k, (a, p, b) in enumerate(parts):
        if p == long:  # bytes are cut there, those of the spaces around it as well
            assert long[20:-20] not in have[k] and len(have[k]) <= len(a + b) + 2
        else:
            assert have[k].split() == " ".join((a, p, b) if p == fifty else (a, b)).split()
