"""Operators whose plans were rebuilt, against plain Python."""

import math
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quern.functions import text as X
from quern.operators import classify, graph, language_model, lookup, reports, search, similarity, spelling, tabular, timeseries
from quern.sources import readers


def test_multimap_keeps_all_fields(spark):
    lines = spark.createDataFrame([(1, "k\ta\tb"), (2, "k\tc"), (3, "alone")], "line_num long, value string")
    assert {r["key"]: r["values"] for r in readers.multimap(lines).collect()} == {"k": ["a", "b", "c"]}


def test_phrases_of_any_length(spark):
    rnd = random.Random(3)
    words = [rnd.choice("abcdefgh") for _ in range(400)]
    phrases = {" ".join(words[i : i + n]) for i, n in ((3, 2), (20, 9), (60, 12), (100, 25), (140, 1), (141, 3), (200, 2))}
    table = spark.createDataFrame([(p, str(k)) for k, p in enumerate(sorted(phrases))], "phrase string, value string")
    docs = spark.createDataFrame([(1, " ".join(words)), (2, "")], "doc_id long, text string")
    expected, i = [], 0
    while i < len(words):
        n = next((n for n in range(25, 0, -1) if i + n <= len(words) and " ".join(words[i : i + n]) in phrases), 0)
        if n:
            expected.append((i, n))
        i += max(n, 1)
    for most, compiled in ((None, 1 << 20), (25, 1 << 20), (25, 0)):
        out = lookup.spot_phrases(docs, "doc_id", F.filter(F.split("text", " "), lambda w: w != ""), table, most, compiled)
        assert sorted((r["start"], r["n"]) for r in out.collect()) == expected
    assert lookup.spot_phrases(docs, "doc_id", F.split("text", " "), table.limit(0)).count() == 0


def test_neighbours_in_blocks(spark):
    rnd = random.Random(1)
    rows = [(i, [rnd.choice([0.0, 1.0, 2.0]) for _ in range(4)], rnd.choice("xyz")) for i in range(120)]
    rows = [(i, [v + 0.5 for v in x], y) for i, x, y in rows]
    df = spark.createDataFrame(rows, "id long, v array<double>, l string")
    found = {(r["query"], r["rank"]): r["id"] for r in similarity.nearest_by_distance(df, df.where("id % 30 = 0"), "id", "v", 5).collect()}
    cosine = {(r["query"], r["rank"]): (r["id"], r["score"]) for r in similarity.nearest_vectors(df, df.where("id % 30 = 0"), "id", "v", 5).collect()}
    assert cosine == {(r["query"], r["rank"]): (r["id"], r["score"]) for r in similarity.nearest_vectors(df.repartition(5), df.where("id % 30 = 0"), "id", "v", 5, sent=0).collect()}
    assert similarity.nearest_vectors(df, df.limit(0), "id", "v", 5).count() == 0
    votes = {r["id"]: r["l"] for r in classify.nearest_neighbours(df.where("id % 30 = 0").select("id", "v"), df, "id", "v", "l").collect()}
    for q in range(0, 120, 30):
        a = rows[q][1]
        near = sorted((sum((x - y) ** 2 for x, y in zip(a, b, strict=True)), i) for i, b, _ in rows if i != q)[:5]
        assert [found[q, k + 1] for k in range(5)] == [i for _, i in near]
        count = Counter(rows[i][2] for _, i in near)
        assert votes[q] == min(count, key=lambda x: (-count[x], x))
        cos = sorted((-round(sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(y * y for y in b)), 6), i) for i, b, _ in rows if i != q)[:5]
        assert [cosine[q, k + 1] for k in range(5)] == [(i, -s) for s, i in cos]


def test_curves_and_areas(spark):
    rnd = random.Random(2)
    rows = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(500)]
    df = spark.createDataFrame(rows, "y int, s double")
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    auc = sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))
    r = classify.curve_areas(df, "y", "s").first()
    assert abs(r["roc_auc"] - auc) < 1e-6
    ap = sum(y * sum(a for a, b in rows if b >= s) / sum(1 for _, b in rows if b >= s) for y, s in rows) / len(pos)
    assert abs(r["average_precision"] - ap) < 1e-6
    points = {p["s"]: (p["tp"], p["fp"]) for p in classify.roc_points(df, "y", "s").collect()}
    assert points == {s: (sum(p >= s for p in pos), sum(n >= s for n in neg)) for s in {s for _, s in rows}}
    one = classify.curve_areas(df.where("y = 1"), "y", "s").first()
    assert one["roc_auc"] is None and one["average_precision"] == 1.0
    assert classify.roc_points(df.limit(0), "y", "s").count() == 0


def test_stratified_folds(spark):
    rows = [(i, "a" if i % 3 else "b") for i in range(301)] + [(1000 + i, None) for i in range(10)]
    folds = defaultdict(Counter)
    for r in classify.stratified_fold(spark.createDataFrame(rows, "id long, l string"), "id", "l", 5).collect():
        folds[r["l"]][r["fold"]] += 1
    assert sum(sum(c.values()) for c in folds.values()) == len(rows)
    assert all(max(c.values()) - min(c[k] for k in range(5)) <= 1 for c in folds.values())


def test_cross_validation_uses_folds(spark):
    rnd = random.Random(4)
    rows = [(i, "a" if i % 2 else "b", float(i % 2) + rnd.random() / 4, rnd.random()) for i in range(90)]
    df = classify.stratified_fold(spark.createDataFrame(rows, "id long, label string, x double, y double"), "id", "label", 3)
    model = classify.cross_validated(classify.tabular_pipeline(["x", "y"], [], "lr"), folds=3).fit(df)
    assert model.avgMetrics[0] > 0.95


def test_codes_in_the_order_first_seen(spark):
    rnd = random.Random(5)
    rows = [(i, f"v{rnd.randrange(300)}") for i in range(2000)]
    seen = list(dict.fromkeys(v for _, v in rows))
    assert {r["v"]: r["code"] for r in tabular.feature_codes(spark.createDataFrame(rows, "i long, v string"), "v", "i").collect()} == {v: k for k, v in enumerate(seen)}
    assert tabular.feature_codes(spark.createDataFrame([], "i long, v string"), "v", "i").count() == 0


def test_time_sheets_side_by_side(spark):
    text = ["Mon", "9:00 12:30 a task", "13 15 more", "hours: 5.5", "weekly: 5.5", "Tue", "9 10 x", "hours: 2"]
    lines = spark.createDataFrame([(f, k, t) for f in ("p", "q") for k, t in enumerate(text)], "file string, line_num long, text string")
    days = reports.timesheet(lines)
    assert sorted((r["file"], r["week"], r["day"], r["hours"], r["matches"]) for r in days.collect()) == sorted((f, w, d, h, m) for f in ("p", "q") for w, d, h, m in ((0, "mon", 5.5, True), (1, "tue", 1.0, False)))
    assert reports.weekly_pivot(days).count() == 4


def test_closure_without_a_checkpoint_folder(spark):
    out = {tuple(r) for r in graph.transitive_closure(spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5)], "x long, y long")).collect()}
    assert out == {(a, b) for a in (1, 2, 3) for b in (1, 2, 3)} | {(4, 5)}


def test_order_3_model(spark):
    """Probabilities of all words after a context add up to one; unknown words are counted and listed."""
    rows = spark.createDataFrame([(1, "a b a c a b"), (2, "b a b c"), (3, "a a b b c c a")], "id long, text string")
    model = language_model.kneser_ney(rows, X.words("text"), 3)
    test = spark.createDataFrame([(k, f"a b {w}") for k, w in enumerate(["a", "b", "c", "zzz", ""])], "id long, text string")
    detail = language_model.score_detail(test, "id", X.words("text"), model).where("pos = 3").collect()
    assert len(detail) == 5 and abs(sum(10 ** r["lp"] for r in detail) - 1) < 1e-9
    assert {r["word"]: r["matched"] > 0 for r in detail}["zzz"] is False
    scores = {r["id"]: r for r in language_model.score_sentences(test, "id", X.words("text"), model).collect()}
    assert scores[3]["n_unknown"] == 1 and scores[4]["n_words"] == 3 and scores[0]["perplexity"] > 1
    assert [(r["word"], r["n"]) for r in language_model.unknown_words(test, X.words("text"), model).collect()] == [("zzz", 1)]


@pytest.mark.parametrize("line, expected", [
    ("apache license", {1, 2, 3}),
    ("+apache +license", {1}),
    ("apache AND license", {1}),
    ('"apache license"', {1}),
    ("apache -license", {2}),
    ("lic*", {1, 3}),
    ("name:alpha", {1}),
])
def test_query_parser(spark, line, expected):
    docs = spark.createDataFrame([(1, "the apache license", "alpha"), (2, "an apache tribe", "beta"), (3, "a license of none", "gamma"), (4, "", "delta")], "doc_id long, text string, name string")
    index = search.field_index(docs, "doc_id", {"text": F.col("text"), "name": F.col("name")})
    assert {r["doc_id"] for r in search.run_query(index, "doc_id", line, docs.count()).collect()} == expected


def test_stored_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c")], "doc_id long, text string")
    search.write_index(search.field_index(docs, "doc_id", {"text": F.col("text")}), str(tmp_path / "index"))
    index = search.read_index(spark, str(tmp_path / "index"))
    assert {r["doc_id"]: r["score"] > 0 for r in search.run_query(index, "doc_id", "a", 2).collect()} == {1: True}


def test_long_words_find_their_neighbours(spark):
    rnd = random.Random(7)
    word = "".join(rnd.choices("abcdefghij", k=240))
    near = word[:200] + "x" + word[201:]
    vocabulary = spark.createDataFrame([(near, 5), ("other", 9)], "term string, df long")
    out = spelling.suggest(spark.createDataFrame([(word,)], "word string"), vocabulary).collect()
    assert [(r["term"], r["distance"]) for r in out] == [(near, 1)]


def test_variants_roots_synonyms_and_senses(spark):
    pairs = spark.createDataFrame([("cat", "cats"), ("dog's", "dog"), ("go", "went"), ("colour", "color"), ("mice", "mouse"), ("cat", "dog")], "a string, b string")
    derived = spark.createDataFrame([("went", "go")], "word string, form string")
    rules = spark.createDataFrame([("color", ["colour", "hue"])], "source string, targets array<string>")
    roots = spark.createDataFrame([("mice", "mouse"), ("mouse", "mouse"), ("cat", "cat"), ("dog", "dog")], "word string, root string")
    out = {(r["a"], r["b"]): r["variant"] for r in spelling.variants(pairs, "a", "b", derived, rules, roots).collect()}
    assert out == {("cat", "cats"): True, ("dog's", "dog"): True, ("go", "went"): True, ("colour", "color"): True, ("mice", "mouse"): True, ("cat", "dog"): False}
    words = spark.createDataFrame([("mice",), ("walking",), ("flies",), ("xyz",)], "word string")
    known = spark.createDataFrame([("walk",), ("fly",)], "word string")
    exceptions = spark.createDataFrame([("mice", "mouse")], "word string, root string")
    found = {r["word"]: r["root"] for r in graph.roots(words, exceptions, [("ing", ""), ("ies", "y")], known).collect()}
    assert found == {"mice": "mouse", "walking": "walk", "flies": "fly", "xyz": "xyz"}
    senses = spark.createDataFrame([("car", "s1", 1), ("auto", "s1", 1), ("car", "s2", 2)], "word string, synset string, rank int")
    assert {tuple(r) for r in graph.synonyms(senses).collect()} == {("car", "auto"), ("auto", "car")}
    assert {r["word"]: r["synset"] for r in graph.first_sense(spark.createDataFrame([("car",), ("no",)], "word string"), senses).collect()} == {"car": "s1", "no": None}


def test_entities_and_rows_as_records(spark, tmp_path):
    from quern.sources import writers

    gazetteer = spark.createDataFrame([("new york", "GPE"), ("york", "PER")], "phrase string, value string")
    docs = spark.createDataFrame([(1, "in new york now")], "doc_id long, text string")
    assert [r["entity"] for r in lookup.entities(docs, "doc_id", F.split("text", " "), gazetteer).collect()] == ["GPE:new york"]
    writers.write_rows(spark.createDataFrame([("f1", 1, "a"), ("f2", 2, "b")], "name string, n int, t string"), "name", str(tmp_path / "rows"), 1)
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "rows")).collect()} == {("f1", "1 a"), ("f2", "2 b")}
    model = classify.tabular_pipeline(["x"], [], "lr").fit(spark.createDataFrame([("a", 0.0), ("b", 1.0), ("a", 0.1), ("b", 0.9)], "label string, x double"))
    writers.save_model(model, str(tmp_path / "model"))
    out = writers.load_model(str(tmp_path / "model")).transform(spark.createDataFrame([("a", 0.05)], "label string, x double")).first()
    assert out["prediction"] == 0.0


def test_small_functions(spark):
    from quern.functions import scalars

    df = spark.createDataFrame([([(1, "a"), (2, "b")], "docid=7 tfidf=[x:1.5 a:b:2]", "é")], "z array<struct<n:int,c:string>>, line string, ch string")
    r = df.select(*scalars.unzip(F.col("z"), ["n", "c"]), scalars.parse_weights(F.col("line")).alias("w"), scalars.category(F.col("ch")).alias("cat")).first()
    assert r["n"] == [1, 2] and r["c"] == ["a", "b"] and r["w"]["doc"] == "7" and r["w"]["weights"] == {"x": 1.5, "a:b": 2.0} and r["cat"] == "Ll"


def test_messages_of_sheets(spark):
    text = ["Mon", "9:00 11:00 a", "hours: 3", "Tue", "9:00 10:00 b", "hours: 1", "weekly: 4", "Wed", "8:00 12:00 c", "weekly: 4", "total: 8"]
    lines = spark.createDataFrame(list(enumerate(text)), "line_num int, text string")
    out = {(r["level"], r["part"]): r["message"] for r in reports.sheet_messages(lines).collect()}
    assert out == {("day", 1): "day 1 has 2.0 hours, 3.0 stated", ("week", 0): "week 0 has 3.0 hours, 4.0 stated", ("sheet", 0): "sheet has 7.0 hours, 8.0 stated"}


def test_stamped_values_up_to_a_cutoff(spark):
    df = spark.createDataFrame([(["5@1/1/2001", "x@1/2/2001", "10.5@1/3/2001", "7@1/5/2001", "8@1/2/2001"],)], "v array<string>")
    at = lambda c: [(x["value"], x["ts"]) for x in df.select(timeseries.stamped_until(F.col("v"), c).alias("x")).first()["x"]]
    assert [v for v, _ in at(F.lit(978652800 - 86400))] == [5.0, 10.5] and [v for v, _ in at(F.lit(None).cast("long"))] == [5.0, 10.5, 7.0, 8.0]


def test_names_of_characters(spark):
    df = spark.createDataFrame([(1, "é"), (2, "A"), (3, "A"), (4, None), (5, "\n")], "k int, c string")
    out = {r["k"]: r["name"] for r in X.character_names(df, "c").collect()}
    assert out == {1: "LATIN SMALL LETTER E WITH ACUTE", 2: "LATIN CAPITAL LETTER A", 3: "LATIN CAPITAL LETTER A", 4: None, 5: ""}
