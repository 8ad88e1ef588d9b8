import random

import numpy as np

from gridcast.llm import toxicity


def made(rng, toxic):
    w = ["".join(rng.choice(["re", "an", "th", "on", "le", "é"]) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(5, 80))]
    if toxic:
        for _ in range(3):
            w.insert(rng.randrange(len(w)), "zwurg" + rng.choice(["an", "le", "th"]))
    return " ".join(w)


def test_held_out_accuracy(spark, documents):
    rng = random.Random(4)
    toxic = {i: i % 5 == 0 for i in range(500)}
    docs = documents([made(rng, toxic[i]) for i in range(500)])
    labels = spark.createDataFrame([(i, int(toxic[i])) for i in range(350)] + [(351, None), (None, 1)], "doc_id long, toxic int")
    scored = {r.doc_id: r for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
    assert np.mean([scored[i].predicted == toxic[i] for i in range(350, 500)]) > 0.97
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in scored.values())


def test_bound_on_labelled_rows(spark, documents):
    rng = random.Random(5)
    docs = documents([made(rng, i % 2) for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    first, second = (toxicity.fit(docs.repartition(n), labels.repartition(n), max_rows=40) for n in (1, 5))
    assert np.allclose(first.pull, second.pull) and (first.ratios != 0).any()


def test_no_labels_one_class_and_blank_texts(spark, documents, clashing):
    docs = clashing(documents([None, "", "some words", "x" * 200_000]))
    labels = spark.createDataFrame([(2, 0), (3, 0)], "doc_id long, toxic int")
    for given, expected in ((labels.filter("false"), 0.5), (labels, 0.0)):
        got = toxicity.score(docs, toxicity.fit(docs, given)).collect()
        assert len(got) == 4 and all(abs(r.score - expected) < 1e-3 for r in got)
    assert toxicity.score(documents([]), toxicity.fit(documents([]), labels)).count() == 0


def test_features_lie_in_words_and_pieces_agree(monkeypatch):
    marks = np.zeros(toxicity.BUCKETS, dtype=bool)
    one = set(toxicity.features("abcdef gh", marks).tolist())
    assert set(toxicity.features("abcdef", marks).tolist()) | set(toxicity.features("gh", marks).tolist()) == one
    assert not marks.any()
    text = made(random.Random(6), True) * 5
    whole = toxicity.features(text, marks).tolist()
    monkeypatch.setattr(toxicity, "CHUNK", 61)
    assert toxicity.features(text, marks).tolist() == whole
