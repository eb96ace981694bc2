"""Tagging, discriminants, model search, sentiment and keyword sets against brute force."""

import itertools
import json
import math
import random

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.fpm import FPGrowth
from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from quern.operators import discriminant, model_search, search, sentiment, tagging


def sentences(n, seed):
    """Tags that follow one another, words that several tags share."""
    rnd = random.Random(seed)
    follow = {"D": "NNNJ", "J": "NNJ", "N": "VVDP", "V": "DDJN", "P": "DDN"}
    words = {"D": ["the", "a", "this"], "J": ["red", "light", "open"], "N": ["light", "walk", "run", "dog"], "V": ["walk", "run", "open"], "P": ["in", "of"]}
    out = []
    for s in range(n):
        tag = rnd.choice("DN")
        for pos in range(rnd.randint(1, 9)):
            out.append((s, pos, rnd.choice(words[tag]), tag))
            tag = rnd.choice(follow[tag])
    return out


SCHEMA = "s long, pos int, word string, tag string"


def test_viterbi_is_the_best_of_all_paths():
    rng = np.random.default_rng(1)
    for n in range(1, 6):
        e, starts, moves = rng.standard_normal((n, 3)), rng.standard_normal(3), rng.standard_normal((3, 3))
        value = lambda p: starts[p[0]] + sum(e[i, t] for i, t in enumerate(p)) + sum(moves[a, b] for a, b in itertools.pairwise(p))  # noqa: B023, E731
        assert tuple(tagging.viterbi(e, starts, moves)) == max(itertools.product(range(3), repeat=n), key=value)


def test_tagging_in_context(spark):
    train, held = sentences(400, 1), sentences(80, 2)
    model = tagging.train(spark.createDataFrame(train, SCHEMA), "s", "pos")
    out = {(r["s"], r["pos"]): r["tag"] for r in tagging.tag_words(spark.createDataFrame(held, SCHEMA), model, "s", "pos").collect()}
    counts = {}
    for _, _, w, t in train:
        counts.setdefault(w, {}).setdefault(t, 0)
        counts[w][t] += 1
    common = sum(max(counts[w], key=counts[w].get) == t for _, _, w, t in held)
    right = sum(out[s, p] == t for s, p, _, t in held)
    assert len(out) == len(held) and right > 1.1 * common
    # The same by brute force: counts with a tenth added, all paths of short sentences.
    tags, smooth = sorted({t for *_, t in train}), 0.1
    size = {t: sum(x[3] == t for x in train) for t in tags}
    kinds = len({x[2] for x in train})
    follows = [(a[3], b[3]) for a, b in itertools.pairwise(train) if a[0] == b[0]]
    first = [x[3] for x in train if x[1] == 0]
    start = {t: math.log((first.count(t) + smooth) / (len(first) + smooth * len(tags))) for t in tags}
    move = {(a, b): math.log((follows.count((a, b)) + smooth) / (sum(x == a for x, _ in follows) + smooth * len(tags))) for a in tags for b in tags}
    emit = lambda w, t: math.log((counts[w].get(t, 0) + smooth) / (size[t] + smooth * (kinds + 1)))
    for s in range(80):
        own = [(p, w) for x, p, w, _ in held if x == s]
        if len(own) <= 5:
            value = lambda path: start[path[0]] + sum(emit(w, t) for (_, w), t in zip(own, path, strict=True)) + sum(move[x] for x in itertools.pairwise(path))  # noqa: B023, E731
            assert value([out[s, p] for p, _ in own]) == pytest.approx(max(map(value, itertools.product(tags, repeat=len(own)))))


def test_tagging_of_odd_rows(spark):
    model = tagging.train(spark.createDataFrame(sentences(50, 3) + [(1, 99, None, "N"), (2, 99, "x", None)], SCHEMA), "s", "pos")
    out = tagging.tag_words(spark.createDataFrame([(1, 0, "unseen", ""), (1, 1, None, ""), (None, 0, "the", "")], SCHEMA), model, "s", "pos").collect()
    assert len(out) == 3 and all(r["tag"] in model.tags for r in out)
    none = tagging.train(spark.createDataFrame([], SCHEMA), "s", "pos")
    assert tagging.tag_words(spark.createDataFrame([(1, 0, "a", "")], SCHEMA), none, "s", "pos").first()["tag"] is None


def test_discriminants_against_plain_fits(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((4, 6)) * 2
    label = np.arange(300) % 4
    x = centres[label] + rng.standard_normal((300, 6)) @ rng.standard_normal((6, 6)) * 0.7
    fold = (np.arange(300) // 4) % 5
    rows = spark.createDataFrame([(i, x[i].tolist(), f"c{label[i]}", int(fold[i])) for i in range(300)] + [(900, None, "c1", 1), (901, [0.0] * 6, None, 1)], "id long, v array<double>, label string, fold int").repartition(3)
    out = discriminant.cross_validated(rows, "id", "v", "label", "fold", 5)
    got = {(r["model"], r["id"]): r["predicted"] for r in out.collect()}
    assert len(got) == 600
    for f in range(5):
        t, h = fold != f, np.flatnonzero(fold == f)
        means = np.stack([x[t & (label == c)].mean(axis=0) for c in range(4)])
        within = x[t] - means[label[t]]
        inverse = np.linalg.inv(within.T @ within / (t.sum() - 4))
        share = np.log([(t & (label == c)).sum() / t.sum() for c in range(4)])
        lda = (x[h] @ inverse @ means.T - 0.5 * np.einsum("ci,ij,cj->c", means, inverse, means) + share).argmax(axis=1)
        var = np.stack([x[t & (label == c)].var(axis=0) for c in range(4)])
        gnb = (share - 0.5 * (np.log(2 * np.pi * var)[None] + (x[h][:, None] - means[None]) ** 2 / var[None]).sum(axis=2)).argmax(axis=1)
        for i, a, b in zip(h, lda, gnb, strict=True):
            assert (got["lda", i], got["gnb", i]) == (f"c{a}", f"c{b}")
    table = {r["model"]: r for r in discriminant.accuracies(out).collect()}
    assert table["lda"]["folds"] == 5 and table["lda"]["mean"] >= table["gnb"]["mean"] > 0.5


def test_halving_keeps_the_best(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((240, 3))
    rows = spark.createDataFrame([(i, [float(a) for a in x[i]], float(x[i, 0] + 0.3 * x[i, 1] > 0), i % 2) for i in range(240)], "id long, v array<double>, label double, fold int")
    rows = rows.withColumn("features", array_to_vector("v"))
    settings = [{"penalty": p} for p in (100.0, 0.001, 50.0, 10.0)]
    out = model_search.halving_search(rows, "id", "label", "fold", settings, lambda s: LogisticRegression(regParam=s["penalty"], elasticNetParam=1.0, maxIter=20), rungs=3).collect()
    assert [sum(r["rung"] == k for r in out) for k in range(3)] == [4, 2, 1] and [r["share"] for r in out if r["rank"] == 1] == [0.25, 0.5, 1.0]
    assert all(json.loads(r["setting"])["penalty"] == 0.001 for r in out if r["rank"] == 1) and out[-1]["mean"] > 0.9
    space = {"a": [1, 2, 3], "b": [1, 2]}
    assert model_search.random_settings(space, 4, 1) == model_search.random_settings(space, 4, 1) and len(model_search.random_settings(space, 99, 1)) == 6


def test_sentiment_in_its_surroundings(spark):
    texts = ["good", "not good", "very good", "not very good", "GOOD news", "ALL GOOD", "bad but good", "good but bad", "good!!", "good!!!!!!", "slightly good", "never was it bad", "plain", "", None, "very one two good"]
    of = lambda rows, schema: spark.createDataFrame(rows, schema)
    lexicon, boosters, negations = of([("good", 1.9), ("bad", -2.5)], "word string, value double"), of([("very", 0.293), ("slightly", -0.293)], "word string, value double"), of([("not",), ("never",)], "word string")
    out = {r["k"]: r["compound"] for r in sentiment.compound(of(list(enumerate(texts)), "k long, text string"), "k", F.col("text"), lexicon, boosters, negations).collect()}
    values = [1.9, 1.9 * -0.74, 2.193, (1.9 + 0.293) * -0.74, 1.9 + 0.733, 1.9, -1.25 + 2.85, 0.95 - 3.75, 1.9 + 0.584, 1.9 + 1.168, 1.9 - 0.293, -2.5 * -0.74, 0, 0, 0, 1.9 + 0.293 * 0.9]
    # "never" stands three words before "bad"
    assert [out[k] for k in range(len(texts))] == [pytest.approx(v / math.sqrt(v * v + 15), abs=2e-6) for v in values]


def test_sets_of_keywords(spark):
    rnd = random.Random(5)
    docs = [(d, t) for d in range(60) for t in set(rnd.choices("abcdefgh", k=4))]
    counts = {}
    for d in range(60):
        own = sorted(t for x, t in docs if x == d)
        for n in range(2, len(own) + 1):
            for s in itertools.combinations(own, n):
                counts[" ".join(s)] = counts.get(" ".join(s), 0) + 1
    expected = sorted(((s, n) for s, n in counts.items() if n >= 5), key=lambda x: (-x[1], x[0]))[:25]
    assert list(map(tuple, search.keyword_sets(spark.createDataFrame(docs, "d long, term string"), "d").collect())) == expected
    assert search.keyword_sets(spark.createDataFrame([], "d long, term string"), "d").count() == 0


def test_sets_of_keywords_among_many_less_frequent_ones(spark, monkeypatch):
    rows = [(d, f"w{d % 6}_{t}") for d in range(60) for t in range(8)] + [(d, t) for d in range(100, 130) for t in "abc"] + [(d, t) for d in range(200, 212) for t in ("a", "b", f"x{d}")]
    docs = spark.createDataFrame(rows, "d long, term string")
    monkeypatch.setattr(search, "FIRST_TERMS", 3)
    seen = []
    fit = FPGrowth.fit
    monkeypatch.setattr(FPGrowth, "fit", lambda self, df: seen.append(df.count()) or fit(self, df))
    assert list(map(tuple, search.keyword_sets(docs, "d", most=3).collect())) == [("a b", 42), ("a b c", 30), ("a c", 30)]
    assert seen == [42]  # documents without a term in a frequent pair stay out of the trees
    monkeypatch.setattr(search, "FIRST_TERMS", 1)
    assert search.keyword_sets(docs, "d", most=2000).count() == 4 + 6 * (2**8 - 9)
    assert list(map(tuple, search.keyword_sets(docs, "d", most=1, least=3).collect())) == [("a b c", 30)]
