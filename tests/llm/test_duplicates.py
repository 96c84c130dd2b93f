"""SimHash, suffix deduplication and vectors against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from rollbook.llm import queries, simhash, suffix, vectors

from ..conftest import SMALL


def fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def roots(n, linked):
    """The smallest number that each of 0..n-1 is linked with, over any number of links."""
    own = list(range(n))

    def find(x):
        while own[x] != x:
            own[x] = x = own[own[x]]
        return x

    for a, b in linked:
        x, y = find(a), find(b)
        own[max(x, y)] = min(x, y)
    return [find(k) for k in range(n)]


def near(values, bits=3):
    v = np.array(values, np.uint64)
    for k in range(len(v)):
        for j in np.flatnonzero(np.bitwise_count(v[k + 1 :] ^ v[k]) <= bits):
            yield k, k + 1 + int(j)


def test_simhash_classes(spark, small):
    docs = sorted((r.doc_id, r.text) for r in small("documents").select("doc_id", "text").collect())
    fps = [fingerprint(t) for _, t in docs]
    own = roots(len(docs), near(fps))
    want = {d: (f"{f:016x}", docs[r][0]) for (d, _), f, r in zip(docs, fps, own, strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, SMALL).collect()} == want


@pytest.mark.parametrize("most", [20_000, 3])
def test_no_link_between_fingerprints_is_lost(spark, monkeypatch, most):
    rng = random.Random(1)
    monkeypatch.setattr(simhash, "MOST", most)
    seeds = [rng.getrandbits(64) for _ in range(60)]
    fps = set(seeds)
    for s in seeds:
        for k in range(6):
            x = s
            for b in rng.sample(range(64), k % 5):
                x ^= 1 << b
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    found = [(fps.index(int(np.int64(r.u).view(np.uint64))), fps.index(int(np.int64(r.v).view(np.uint64)))) for r in simhash.links(df).collect()]
    assert roots(len(fps), found) == roots(len(fps), near(fps))


def test_simhash_of_odd_rows(spark, odd, nothing):
    rows = {(r.id, r.fp): r.component_id for r in simhash.classes(odd).collect()}
    assert rows[2, 0] == rows[3, 0] == rows[1, 0] == 1
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    ids = [r.doc_id for r in kept.collect()]
    # the two texts under 8 are judged each by itself
    assert sorted(i for i in ids if i) == sorted([*set(i for i in ids if i), 8]) and 1 in ids and 2 not in ids and ids.count(7) == 1
    assert simhash.deduplicate(nothing).count() == 0 and simhash.classes(nothing).count() == 0


def test_simhash_reaches_over_all_rows_of_an_id(spark, new_folder):
    rng = random.Random(3)
    texts = [" ".join(f"w{rng.randrange(5000)}" for _ in range(30)) for _ in range(60)]
    rows = [(rng.randrange(90), rng.choice(texts)) for _ in range(80)] + [(-5, "one"), (200, "one"), (200, "two"), (200, None), (300, "two"), (301, ""), (302, "by itself"), (302, "by itself")]
    spark.createDataFrame(rows + [(None, "one"), (None, texts[0])], "doc_id long, text string").write.parquet(f"{new_folder}/documents.parquet")
    fps = [fingerprint(t) for _, t in rows]
    first = {d: k for k, (d, _) in reversed(list(enumerate(rows)))}
    own = roots(len(rows), [*near(fps), *((first[d], k) for k, (d, _) in enumerate(rows))])
    least = {r: min(d for (d, _), x in zip(rows, own, strict=True) if x == r) for r in own}
    want = Counter((d, f"{f:016x}", least[r]) for (d, _), f, r in zip(rows, fps, own, strict=True))
    have = Counter((r.doc_id, r.fingerprint, r.component_id) for r in queries.op5_simhash(spark, new_folder).where("doc_id IS NOT NULL").collect())
    assert have == want and all(least[own[first[d]]] == -5 for d in (200, 300, 301))


def removed(texts, length):
    """A byte is removed if a string of that length that covers it also starts anywhere else."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d), bool)
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = np.frombuffer(d, np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1))
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def test_suffix_dedup(spark, small):
    docs = [(r.doc_id, r.text) for r in small("documents").select("doc_id", "text").collect()]
    want = {d: x for (d, _), x in zip(docs, removed([t for _, t in docs], 400), strict=True)}
    have = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op7_suffix_dedup(spark, SMALL).collect()}
    assert have == want and sum(x[1] for x in want.values())


@pytest.mark.parametrize(("most", "alphabet"), [(50_000, "ab"), (2, "abcdé"), (1, "ab")])
def test_suffix_dedup_of_dense_repeats(spark, most, alphabet):
    rng = random.Random(most)
    words = ["".join(rng.choice(alphabet) for _ in range(rng.randint(1, 60))) for _ in range(12)]
    texts = ["".join(rng.choice(words) for _ in range(rng.randint(0, 14))) for _ in range(60)] + ["a" * 90, "a" * 41, "ab" * 60, None, "", "b" * 40]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    have = {r.id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.digests(df, length=40, most=most).collect()}
    assert have == dict(enumerate(removed(texts, 40)))


def test_suffix_dedup_counts_passages_of_few_bytes(spark, new_folder):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, long, below = prose(51), prose(120), prose(50)  # 51 words are under 400 bytes
    texts = {1: f"{prose(9)} {shared} {prose(9)}", 2: f"{prose(80)} {shared}", 3: prose(200), 4: f"{long} {prose(30)} {shared}", 5: f"{long} end", 6: f"{below} {prose(3)}", 7: f"{prose(3)} {below}", 8: None, 9: shared, 10: f"{below} x"}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{new_folder}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op7_suffix_dedup(spark, new_folder).collect()}
    assert {d: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for d, r in rows.items()} == dict(zip(texts, removed(texts.values(), 400), strict=True))
    size, much = len(shared.encode()), len(long.encode())
    assert size < 400 < much
    assert {d: (r.n_passages, r.passage_bytes) for d, r in rows.items() if r.n_passages or r.passage_bytes} == {1: (1, size), 2: (1, size), 4: (2, much + size), 5: (1, much), 9: (1, size)}
    assert [d for d, r in rows.items() if r.changed] and all(r.changed == (d in (4, 5)) for d, r in rows.items())


def test_suffix_dedup_of_odd_rows(spark, odd, nothing):
    assert suffix.digests(odd).count() == odd.count()
    kept = suffix.deduplicate(odd)
    assert kept.columns == odd.columns and suffix.deduplicate(nothing).count() == 0 and suffix.digests(nothing).count() == 0
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[7] == 2 and ids[8] == 2 and ids[None] == 2  # too short to be cut
    assert ids[6] + ids[10] <= 1  # all of one is in the other


def test_vectors(same):
    same(queries.op9_embedding_neighbours, queries.oracle_sql()["op9_embedding_neighbours"])


def test_vectors_of_odd_rows(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(8, 6))
    rows = [(k, [float(x) for x in base[k % 8] + 0.02 * rng.normal(size=6)], k % 2, "clash") for k in range(120)]
    rows += [(200, None, 0, ""), (201, [0.0] * 6, 0, ""), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, ""), (203, [float("nan")] * 6, 0, ""), (204, rows[0][1], None, ""), (205, [], 1, ""), (206, rows[1][1], 1, None), (207, [float("inf")] * 6, 1, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, list string")
    have = {r.id: (r.n_links, r.component_id, r.kept) for r in vectors.classes(df).collect()}
    good = [r for r in rows if r[0] < 200 or r[0] == 206]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T >= 0.98) & (np.array([r[2] for r in good])[:, None] == np.array([r[2] for r in good])[None])
    np.fill_diagonal(link, False)
    own = roots(len(good), np.argwhere(link))
    want = {r[0]: (int(link[k].sum()), good[own[k]][0], good[own[k]][0] == r[0]) for k, r in enumerate(good)}
    assert have == want | {k: (0, k, True) for k in (200, 201, 202, 203, 204, 205, 207)}
    assert vectors.classes(df.where("false")).count() == 0


def test_sets_of_a_component_share_the_memory_of_their_column():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    wanted = [rng.integers(-(1 << 62), 1 << 62, k) for k in (0, 1, 200_000, 0, 300_000, 7)]
    whole = pa.array(wanted, pa.list_(pa.int64()))
    column = pa.chunked_array([whole.slice(0, 3), whole.slice(3), whole.slice(0, 0)])
    tracemalloc.start()
    found = simhash._sets(column)
    taken = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert taken < 1 << 20 and len(found) == len(wanted) and all(np.array_equal(a, b) for a, b in zip(found, wanted, strict=True))
