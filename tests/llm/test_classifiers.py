"""Both classifiers on documents that they haven't learned from."""

import numpy as np
import pytest

from rollbook.llm import quality, queries, toxicity

from ..conftest import SMALL

#: Large enough to learn from: some hundred toxic documents.
MEDIUM = SMALL.replace("sf0.001", "sf0.1")


def auc(score, y):
    score, y = np.asarray(score), np.asarray(y)
    return (score[y == 1][:, None] > score[y == 0][None]).mean() + 0.5 * (score[y == 1][:, None] == score[y == 0][None]).mean()


@pytest.mark.parametrize(("query", "label", "n", "held", "least"), [(queries.op2_toxicity, "toxic", 3, 1, 0.9), (queries.op10_quality, "quality", 4, 2, 0.9)])
def test_held_out(spark, query, label, n, held, least):
    import zlib

    rows = query(spark, MEDIUM).collect()
    assert len(rows) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    labels = {r.doc_id: r[label] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect() if r[label] is not None}
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == held)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    apart = [r for r in rows if r.held_out and r.doc_id in labels]
    y = np.array([labels[r.doc_id] for r in apart])
    print(label, len(apart), "AUC", auc([r.score for r in apart], y), "accuracy", np.mean([r.predicted == labels[r.doc_id] for r in apart]))
    assert auc([r.score for r in apart], y) >= least
    assert np.mean([r.predicted == labels[r.doc_id] for r in apart]) >= 0.85


@pytest.mark.parametrize("module", [toxicity, quality])
def test_odd_rows(spark, odd, nothing, small, module):
    label = "toxic" if module is toxicity else "quality"
    model = module.fit(small("documents"), small("labels").withColumnRenamed(label, "y").withColumnRenamed("y", label))
    rows = module.score(odd, model)
    assert rows.columns == [c for c in odd.columns if c != "score"] + ["score"]
    rows = rows.collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    empty = {round(r.score, 12) for r in rows if not r.text}
    assert len(empty) == 1
    assert module.score(nothing, model).count() == 0
    # whole texts: what is only at the end of a very long text counts
    none = module.fit(nothing, spark.createDataFrame([], f"doc_id long, {label} int"))
    assert {round(r.score, 9) for r in module.score(odd, none).collect()} == {round(none.score([""])[0], 9)}
    one = module.fit(odd, spark.createDataFrame([(7, 1), (7, None), (4, None), (None, 1)], f"doc_id long, {label} int"))
    assert all(0 <= r.score <= 1 for r in module.score(odd, one).collect())


def test_toxic_words_count_at_the_end_of_a_long_text(small):
    toxic = {r.doc_id: r.toxic for r in small("labels").collect()}
    rows = [r for r in small("documents").collect() if r.text and toxic.get(r.doc_id) is not None]
    model = toxicity.fit_texts([r.text for r in rows], np.array([toxic[r.doc_id] for r in rows]))
    plain = next(r.text for r in rows if not toxic[r.doc_id] and model.score([r.text])[0] < 0.3)
    bad = next(r.text for r in rows if toxic[r.doc_id] and model.score([r.text])[0] > 0.7)
    assert model.score([plain * 50 + " " + bad])[0] > model.score([plain * 50])[0]


def test_toxic_words_behind_any_sign_count(small):
    toxic = {r.doc_id: r.toxic for r in small("documents").sparkSession.read.parquet(f"{MEDIUM}/labels.parquet").collect()}
    rows = [r for r in small("documents").sparkSession.read.parquet(f"{MEDIUM}/documents.parquet").collect() if r.text and toxic.get(r.doc_id) is not None][:2000]
    model = toxicity.fit_texts([r.text for r in rows], np.array([toxic[r.doc_id] for r in rows]))
    plain = next(r.text for r in rows if not toxic[r.doc_id] and len(r.text) > 1000 and model.score([r.text])[0] < 0.3)[:1000]
    score = lambda t: float(model.score([t])[0])
    bad = [w.decode().strip() for w in toxicity._telling([r.text for r in rows], np.array([toxic[r.doc_id] for r in rows])) if len(w) > 6]
    spread = lambda mark: "".join(f"{plain[k * 40 : k * 40 + 40]} {mark}{w} " for k, w in enumerate(bad[:20]))
    base = score(spread(" "))
    for mark in ("\u201c", "\u00ab", "\u00bf", "\u2014", "\u00a0", "("):
        assert abs(score(spread(mark)) - base) < 1e-9
    # every window is compressed, so the dictionary decides: without the toxic one there is no evidence
    gone = toxicity.ToxicityModel(model.ordinary, b"", model.mean, model.scale, model.weights)
    assert gone.score([spread(" ")])[0] < base
