import random

import numpy as np
import pytest

from lodestrand.llm import subjects

TOPICS = {"boats": "keel rudder mast anchor hull tide sail deck".split(), "bread": "dough yeast oven crust flour knead loaf rye".split(), "chess": "rook pawn bishop gambit castle mate queen knight".split()}
FILLER = "return value index table count for if else list map node error".split()


def make(n=400, seed=5):
    rng = random.Random(seed)
    docs, truth = [], []
    for i in range(n):
        own = set(rng.sample(sorted(TOPICS), rng.choice([1, 1, 1, 2])))
        pool = [w for t in own for w in TOPICS[t]]
        text = [rng.choice(pool) + rng.choice(["", "Value", "_count"]) for _ in range(40)] + [rng.choice(FILLER) for _ in range(60)]
        text += [rng.choice(TOPICS[rng.choice(sorted(TOPICS))])] * (i % 3 == 0)
        rng.shuffle(text)
        docs.append((i, " ".join(text), "x"))
        truth.append(own)
    return docs, truth


def test_words_split_identifiers():
    assert subjects.words("parseHTTPReply max_value2x état x") == ["parse", "http", "reply", "max", "value", "état"]
    assert subjects.words("") == [] and subjects.words("a 1 _") == []


def test_held_out_documents(spark):
    docs, truth = make()
    labels = [(i, s, "r") for i in range(120) for s in truth[i]] + [(0, next(iter(truth[0])), "r"), (5, "unknown", "r"), (10**6, "boats", "r"), (None, "boats", "r")]
    odd = [(10_000, None, "x"), (10_001, "", "x"), (10_002, " \n", "x"), (10_003, "x" * 100_000, "x")]
    frame = spark.createDataFrame(docs + odd, "doc_id bigint, text string, mask string")
    scored, names, threshold = subjects.subject_posteriors(frame, spark.createDataFrame(labels, "doc_id bigint, subject string, rater string"), spark.createDataFrame([(s,) for s in TOPICS] + [("boats",)], "subject string"))
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert len(rows) == len(docs) + len(odd) and all(rows[i]["posteriors"] is None for i in (10_000, 10_001, 10_002))
    got = {(r["doc_id"], r["subject"]) for r in subjects.assign(scored.filter("mask is null"), names, threshold).collect() if r["doc_id"] < 10_000}
    want = {(i, s) for i in range(120, len(docs)) for s in truth[i]}
    assert len(got & want) / len(got) > 0.97 and len(got & want) / len(want) > 0.97


def test_no_labels_is_an_error(spark):
    frame = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    with pytest.raises(ValueError):
        subjects.subject_posteriors(frame, spark.createDataFrame([], "doc_id bigint, subject string"), spark.createDataFrame([("s",)], "subject string"))


def test_row_sums_of_empty_rows():
    assert subjects._row_sums(np.array([[1.0, 2.0, 3.0]]), np.array([0, 0, 2, 2, 3, 3])).tolist() == [[0, 3, 0, 3, 0]]


def test_weights_out_of_fold_are_those_of_the_other_documents(monkeypatch):
    """Taking a document's counts away gives the model that was never shown it."""
    monkeypatch.setattr(subjects, "CELLS", 32)
    rng = np.random.default_rng(2)
    counts = rng.integers(0, 4, (30, 32)) * (rng.random((30, 32)) < 0.6)
    truth = (rng.random((30, 3)) < 0.4).astype(float)

    def model_of(rows, least):
        value = np.log1p(counts[rows])
        model = subjects.Model(3)
        monkeypatch.setattr(subjects, "MIN_DOCS", least)
        model.weigh(np.arange(32), truth[rows].T @ value, (counts[rows] > 0).sum(axis=0), value.sum(axis=0))
        model.shape = (2.0, 1.0)
        return model

    cells = np.flatnonzero(counts[7])
    own, borders = counts[7, cells].astype(np.float32), np.array([0, len(cells)])
    monkeypatch.setattr(subjects, "MIN_DOCS", 1)
    (got,) = model_of(np.arange(30), 1).evidence_out_of_fold(cells, own, borders, truth[[7]], [(2.0, 1.0)])
    want = model_of(np.delete(np.arange(30), 7), 1).evidence(cells, own, borders)
    assert np.allclose(got, want, rtol=1e-4, atol=1e-5)


def test_reliability(spark):
    docs, truth = make(200)
    labels = spark.createDataFrame([(i, s) for i in range(100) for s in truth[i]], "doc_id bigint, subject string")
    features, model, names = subjects.fit(spark.createDataFrame([d[:2] for d in docs], "doc_id bigint, text string"), labels, spark.createDataFrame([(s,) for s in TOPICS], "subject string"))
    rows = subjects.reliability(features, model, bins=2).collect()
    assert names == sorted(TOPICS) and sum(r["n_pairs"] for r in rows) == 300
    assert all(abs(r["mean_posterior"] - r["share_labelled"]) < 0.1 for r in rows)
