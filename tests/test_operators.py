import numpy as np
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.operators import automaton, classify, graph, language_model, lookup, reports, search, setops, similarity, spelling, tabular, tfidf, timeseries


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def lines(spark, *text):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(text)], "line_num long, value string")


def test_filter_include_exclude(spark):
    digits = spark.createDataFrame([(str(i),) for i in range(10)] + [(None,)], "value string")
    odd = spark.createDataFrame([(x,) for x in "1357"], "case string")
    assert sorted(r[0] for r in tabular.filter_rows(digits, F.col("value"), odd, "case").collect()) == list("1357")
    out = [r[0] for r in tabular.filter_rows(digits, F.col("value"), odd, "case", exclude=True).collect()]
    assert sorted(x for x in out if x) == list("024689") and None in out


def test_insert_merge_transpose(spark):
    table = spark.createDataFrame([("3", "Three"), ("2", "Two"), ("1", "One")], "k string, v string")
    data = spark.createDataFrame([("1", "Uno", "Un"), ("4", "Cuatro", "Quatre")], "num string, es string, fr string")
    assert rows(tabular.insert_field(data, "num", table, "k", "v", "en", 2), "num") == [("1", "One", "Uno", "Un"), ("4", "", "Cuatro", "Quatre")]
    a, b = spark.createDataFrame([("x", ["1"])], "k string, v array<string>"), spark.createDataFrame([("x", ["2"]), ("y", ["3"])], "k string, v array<string>")
    assert rows(tabular.merge_lists(a, b, "k", "v"), "k") == [("x", ["1", "2"]), ("y", ["3"])]
    assert rows(tabular.merge_lists(a, b, "k", "v", "left"), "k") == [("x", ["1", "2"])]
    t = spark.createDataFrame([(1, "R1C1", "R1C2"), (2, "R2C1", None)], "n int, c1 string, c2 string")
    assert rows(tabular.transpose(t, "n", ["c1", "c2"]), "position") == [(0, "c1", "R1C1\tR2C1"), (1, "c2", "R1C2\tn/a")]


def test_cut_split_relative(spark):
    assert tabular.field_numbers("7,9 11-13") == [7, 9, 11, 12, 13]
    line = spark.range(1).select(tabular.cut_fields(F.array(F.lit("a"), F.lit("b")), [2, 1, 2, 5], ",").alias("x")).first()[0]
    assert line == "b,a,b,"
    parts = tabular.split_round_robin(spark.range(100), "id", 3).groupBy("split").count()
    assert rows(parts, "split") == [(0, 34), (1, 33), (2, 33)]
    t = spark.createDataFrame([("cat 1", "1", 10.0), ("cat 2", "2", 20.0)], "label string, cat string, v double")
    out = rows(tabular.relative_table(t, "label", "cat", "v", "2").select("label", "diff", "shown"), "label")
    assert out == [("cat 1", -0.5, "10.000 (-0.500)"), ("cat 2", 0.0, "20.000 (*)")]


def test_sets(spark):
    a, b = spark.createDataFrame([(1,), (1,), (2,)], "k int"), spark.createDataFrame([(1,), (3,)], "k int")
    assert rows(setops.union(a, b), "k") == [(1,), (2,), (3,)] and rows(setops.intersection(a, b)) == [(1,)]
    assert rows(setops.difference(a, b)) == [(2,)] and rows(setops.remove_all(a, b), "k") == [(1,), (2,)]
    assert rows(setops.difference(a, spark.createDataFrame([(2,)], "k int"), bag=True)) == [(1,), (1,)]
    assert rows(setops.equivalent(a, b)) == [(False, False)]


def test_search_and_tfidf(spark):
    docs = spark.createDataFrame([(1, "windows nt server"), (2, "nt windows"), (3, "linux nt windows nt")], "id int, text string")
    index = search.postings(docs, "id", "text", positions=True)
    n = docs.agg(F.count("*").alias("n"))
    assert {r[0] for r in search.search(index, "id", ["linux", "server"], n).collect()} == {1, 3}
    assert {r[0] for r in search.search(index, "id", ["nt", "linux"], n, every=True).collect()} == {3}
    phrase = [(1, 1), (3, 1)]
    assert rows(search.search_phrase(docs, "id", "text", ["windows", "nt"]), "id") == phrase == rows(search.phrase_by_positions(index, "id", ["windows", "nt"]), "id")
    w = {(r["id"], r["term"]): r["w"] for r in search.tfidf(index, n).collect()}
    assert w[3, "linux"] == round(np.log(3), 6) and w[3, "nt"] == 0


def test_pruning(spark):
    top = spark.createDataFrame([(1, "new york", 1), (1, "york", 2), (1, "yo", 3), (1, "12", 4), (1, "big new york", 5)], "d int, term string, rank int")
    assert [r[0] for r in tfidf.prune_subsumed(top, "d").orderBy("rank").select("term").collect()] == ["new york", "12", "big new york"]
    assert [r[0] for r in tfidf.prune_overlapping(top, "d").orderBy("rank").select("term").collect()] == ["new york", "yo"]


def test_lookup(spark):
    entries = spark.createDataFrame([("a", 1), ("ab", 2), ("abcdef", 3), ("b", 4), ("bcd", 5), ("b", 6), ("bcd", 7)], "k string, v int")
    assert sorted(r["v"] for r in lookup.find_prefix(entries, "k", "b").collect()) == [4, 5, 6, 7]
    assert rows(automaton.trie_nodes(entries, "k")) == [(5, 10)]
    assert lookup.delete(entries, "k", "v", k="b", v=6).count() == 6 and lookup.delete(entries, "k", "v", prefix="b").count() == 3
    phrases = spark.createDataFrame([("new york", "1"), ("new york city", "2"), ("city hall", "3")], "phrase string, value string")
    docs = spark.createDataFrame([(1, "in new york city hall and new york")], "d int, text string")
    assert rows(lookup.spot_phrases(docs, "d", words("text"), phrases), "start") == [(1, 1, 3, "new york city", "2"), (1, 6, 2, "new york", "1")]


def test_similarity(spark):
    docs = spark.createDataFrame([(1, "red green blue"), (2, "red green black"), (3, "one two three")], "d long, text string")
    v = similarity.tfidf_vectors(similarity.bag_of_words(docs, "d", "text"), "d", docs.agg(F.count("*").alias("n")))
    near = similarity.similar_docs(v, spark.createDataFrame([(1,)], "d long"), "d").collect()
    assert [(r["query"], r["d"]) for r in near] == [(1, 2)] and 0.5 < near[0]["score"] < 1
    titles = ["human machine interface for lab abc computer applications", "a survey of user opinion of computer system response time", "the intersection graph of paths in trees", "graph minors a survey"]
    t = similarity.topics(spark.createDataFrame(list(enumerate(titles)), "d long, text string"), "d", "text", 2)
    assert t.count() == 4 and all(len(r["vector"]) == 2 for r in t.collect())


def test_time_series(spark):
    s = spark.createDataFrame([(1, 0, 5.0), (1, 2 * 86400, 7.0), (1, 3 * 86400, 9.0)], "k int, ts long, value double")
    assert [r["value"] for r in timeseries.resample(s, "k").orderBy("t").collect()] == [5.0, 5.0, 7.0, 9.0]
    burst = spark.createDataFrame([(1, 0, 1.0), (1, 10, 2.0), (1, 86400, 3.0)], "k int, ts long, value double")
    assert rows(timeseries.resample_reference(burst, "k")) == [(1, [1.0, 2.0])]
    assert [r["value"] for r in timeseries.resample(burst, "k").orderBy("t").collect()] == [1.0, 3.0]
    a = np.array([1.0, 2, 3, 4])
    c = timeseries.cross_correlation(a, a)
    assert abs(c[len(c) // 2] - 1) < 1e-12 and len(c) == 7 and len(timeseries.cross_correlation(a, a, 1)) == 3
    stamped = spark.createDataFrame([("5@1/1/2001",), ("x@1/1/2001",)], "v string").select(timeseries.split_stamped(F.col("v")).alias("x"))
    assert [r["x"] and tuple(r["x"]) for r in stamped.collect()] == [(5.0, 978307200), None]
    pairs = spark.createDataFrame([(1, [1.0, 2.0], [1.0, 2.0]), (2, [], [1.0])], "k int, a array<double>, b array<double>")
    out = dict(rows(timeseries.correlation_features(pairs, ["k"], "a", "b")))
    assert out[2] == -123.0 and abs(out[1] - np.mean(timeseries.cross_correlation([1, 2], [1, 2]))) < 1e-6


def test_language_model_filters(spark):
    t = spark.createDataFrame([(1, i, w) for i, w in enumerate("my dog has fleas xx very fat dawg".split())], "id int, pos int, word string")
    uni = spark.createDataFrame([("dog",), ("fleas",), ("dawg",)], "term string")
    bi = spark.createDataFrame([("my dog",), ("dog has",), ("very fat",), ("has fleas",)], "term string")
    assert [r["phrase"] for r in language_model.known_runs(t, ["id"], uni, bi).orderBy("start").collect()] == ["my dog has fleas", "very fat", "dawg"]
    texts = spark.createDataFrame([(i, "administrative assistant") for i in range(9)] + [(9, "manager assistant")], "id int, text string")
    s = dict((r["id"], r["score"]) for r in language_model.bigram_score(texts, "id", words("text")).collect())
    assert s[0] > s[9]


def test_spelling(spark):
    vocabulary = spark.createDataFrame([("technology", 9), ("biology", 5), ("receive", 4)], "term string, df long")
    asked = spark.createDataFrame([("tehnology",), ("recieve",), ("9abc",), ("the",)], "word string")
    found = spelling.suggest(asked, vocabulary, 0.7)
    assert {(r["word"], r["term"]) for r in found.collect()} == {("tehnology", "technology"), ("recieve", "receive")}
    assert {r[0] for r in spelling.unknown_words(asked, vocabulary).collect()} == {"tehnology", "recieve", "9abc", "the"}
    assert {tuple(r)[:2] for r in spelling.replacement(found, vocabulary).collect()} == {("tehnology", "technology"), ("recieve", "receive")}


def test_spelling_long_words(spark):
    """The term shares only the last of the word's parts, the 70 characters at its end."""
    word, end = "ab" * 70, "cdefghi" * 10
    vocabulary = spark.createDataFrame([("axb" * 70 + end, 9)], "term string, df long")
    asked = spark.createDataFrame([("q" * 3 * k,) for k in range(2, 70)] + [(word + end,)], "word string")
    assert [r["distance"] for r in spelling.suggest(asked, vocabulary).collect()] == [70]


def test_graph(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "x int, y int")
    assert len(rows(graph.transitive_closure(edges))) == 6
    loop = spark.createDataFrame([(1, 2), (2, 1)], "x int, y int")
    assert rows(graph.transitive_closure(loop), "x", "y") == [(1, 1), (1, 2), (2, 1), (2, 2)]
    assert rows(graph.ancestors(edges, "x", "y", 2), "node", "ancestor") == [(1, 2, 1), (1, 3, 2), (2, 3, 1), (2, 4, 2), (3, 4, 1)]


def test_reports(spark):
    notes = spark.createDataFrame([("a", 1, "early"), ("a", 2, "Thu 13 Nov 14"), ("a", 3, "x"), ("b", 1, "13 Nov 14"), ("b", 2, "y"), ("b", 3, "Fri 14 Nov 14"), ("b", 4, "z")], "file string, line_num int, text string")
    out = rows(reports.merge_notes(notes).select(F.col("date").cast("string"), "notes"), "date", "notes")
    assert out == [("1900-01-01", "early"), ("2014-11-13", "x"), ("2014-11-13", "y"), ("2014-11-14", "z")]
    sheet = spark.createDataFrame([(1, "Mon"), (2, "9:30 11:30 task"), (3, "1 2 task"), (4, "hours: 3"), (5, "# note"), (6, "Tue"), (7, "9 10 task"), (8, "hours: 2"), (9, "weekly: 4"), (10, "Mon"), (11, "11 1 x")], "line_num int, text string")
    days = reports.timesheet(sheet)
    assert rows(days.select("week", "day", "hours", "matches"), "week", "day") == [(0, "mon", 3.0, True), (0, "tue", 1.0, False), (1, "mon", 2.0, True)]
    assert [r["total"] for r in reports.weekly_pivot(days).orderBy("week").collect()] == [4.0, 2.0]
    files = spark.createDataFrame([("r/a/x", 1), ("r/a/y", 2), ("r/b/z", 4)], "p string, s long")
    assert rows(reports.size_rollup(files, F.col("p"), "s"), "folder") == [("r", 7, 3), ("r/a", 3, 2), ("r/b", 4, 1)]


def test_classify(spark):
    scored = spark.createDataFrame([(1, 1, 0.9), (1, 0, 0.4), (0, 0, 0.1), (0, 1, 0.6)], "y int, p int, s double")
    assert rows(classify.report(scored, "y", "p"), "label") == [(0, 0.5, 0.5, 0.5, 2), (1, 0.5, 0.5, 0.5, 2)]
    assert rows(classify.roc_points(scored, "y", "s").select("tp", "fp"), F.desc("tp"), F.desc("fp"))[0] == (2, 2)
    texts = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze")] * 5, "label string, text string")
    for kind in ("nb", "lr", "svm"):
        model = classify.text_pipeline(kind, 1 << 10).fit(texts)
        assert model.transform(texts).where("prediction = label_index").count() == 10
    points = spark.createDataFrame([(float(i % 3), float(i), "abc"[i % 3], "xy"[i % 2]) for i in range(30)], "f double, g double, label string, c string")
    model = classify.tabular_pipeline(["f", "g", "c"], ["c"], "forest").fit(points)
    assert model.transform(points).where("prediction = label_index").count() > 25
    seq = spark.createDataFrame([(1, ["a"] * 9, ["b"] * 2, "n"), (2, ["a"], [], "y")], "g int, a array<string>, b array<string>, l string")
    out = {r["guid"]: r for r in classify.sequence_features(seq, "g", F.col("a"), F.col("b"), F.col("l"), 8).collect()}
    assert out[1]["tokens"] == ["[CLS]", "a", "a", "a", "[SEP]", "b", "b", "[SEP]"] and out[1]["segments"] == [0] * 5 + [1] * 3
    assert out[2]["mask"] == [1, 1, 1, 0, 0, 0, 0, 0] and out[2]["label_id"] == 1
