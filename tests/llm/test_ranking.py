"""Ranked search by the tree against its SQL and against scoring everything."""

import math
import random
from collections import Counter

import numpy as np
import pytest

from rollbook.llm import queries, ranking


def plain(docs, items, top=10):
    bags = [(d, Counter(ranking.words((t or "").encode()))) for d, t in docs]
    size = [sum(b.values()) for _, b in bags]
    n, total = sum(1 for x in size if x), sum(size)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        found = []
        for (d, b), k in zip(bags, size, strict=True):
            if k:
                m = 25 + 75 * k * n // total
                s = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (10**9 * b[w] // (1000 * b[w] + 8 * m)) for w, q in Counter(ranking.words((text or "").encode())).items() if w in b)
                if s > 0:
                    found.append((-s, d is None, d or 0))
        out += [(item, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(found)[:top])]
    return sorted(out, key=repr)


def rows(df):
    return sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()), key=repr)


def test_query_equals_its_sql(same):
    same(queries.op11_lexical_ranking, queries.OP11)


@pytest.mark.parametrize("trees,leaf,block", [(2_000_000, 16, 8_192), (300, 1, 12), (40, 3, 1)])
def test_small_trees_and_blocks(spark, monkeypatch, trees, leaf, block):
    monkeypatch.setattr(ranking, "ENTRIES_A_TREE", trees)
    monkeypatch.setattr(ranking, "LEAF", leaf)
    monkeypatch.setattr(ranking, "WORDS_A_BLOCK", block)
    rng = random.Random(leaf)
    word = lambda: f"w{int(rng.paretovariate(0.6)) % 80}"
    docs = [(k, " ".join(word() for _ in range(rng.choice((0, 3, 8, 8, 60))))) for k in range(300)]
    docs += [(k, docs[7][1] + " w1") for k in range(300, 330)]  # equal scores, so ids decide
    items = [(k, " ".join(word() for _ in range(rng.randint(1, 9)))) for k in range(12)] + [(99, "w1 w1 nowhere")]
    made = ranking.ranked(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"))
    assert rows(made) == plain(docs, items)


def test_bounds_hold_and_prune():
    rng = np.random.default_rng(2)
    size = rng.integers(0, 9, 400)
    ptr = np.concatenate([[0], np.cumsum(size)])
    term = np.concatenate([np.sort(rng.choice(30, k, replace=False)) for k in size]).astype(np.int64)
    tf = rng.integers(1, 6, len(term))
    m = rng.integers(25, 300, 400)
    tree = ranking.Tree(ptr, term, tf, m, 30, leaf=4)
    asked, weight = np.array([1, 4, 9, 20]), np.array([5, 900, 30, 400])
    of = np.zeros(30, np.int64)
    of[asked] = weight
    exact = np.array([(of[term[a:b]] * ranking.impact(tf[a:b], m[k])).sum() for k, (a, b) in enumerate(zip(ptr[:-1], ptr[1:], strict=True))])
    bound = tree.bounds(asked, weight)
    for v, (a, b) in enumerate(zip(tree.low, tree.high, strict=True)):
        assert bound[v] >= exact[tree.order[a:b]].max(initial=0)
    leaves = [(a, b) for a, b, below in zip(tree.low, tree.high, tree.below, strict=True) if not below]
    assert sorted(k for a, b in leaves for k in range(a, b)) == list(range(400))
    seen, best = [], ranking.Best(3)

    def wanted(docs, scores):
        seen.extend(docs)
        for d, s in zip(docs.tolist(), scores.tolist(), strict=True):
            best.put(s, d)
        return best.least()

    tree.search(asked, weight, 1, wanted)
    assert sorted(s for s, _ in best.rows()) == sorted(exact)[-3:]
    assert len(seen) < np.count_nonzero(exact)


def test_odd_rows(spark, odd, nothing, small):
    items = spark.createDataFrame([(1, "One, two!"), (1, "One, two!"), (2, None), (3, " .. "), (4, "word7"), (None, "text id")], "item_id int, text string")
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    have = ranking.ranked(odd, items)
    assert have.schema["item_id"].dataType.simpleString() == "int"
    assert rows(have) == plain(docs, [(1, "One, two!"), (4, "word7"), (None, "text id")])
    assert ranking.ranked(nothing, small("benchmark")).count() == 0
    assert ranking.ranked(odd, small("benchmark").limit(0)).count() == 0
