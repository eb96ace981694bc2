"""What a plan does at size: where rows are exchanged and how often they are worked out."""

from pyspark.sql import functions as F

from quern.operators import classify, reports, search, sentiment, spelling


def plan(df, kind="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), kind)().toString()


def test_ranges_of_scores_are_found_after_the_rows_are_counted(spark):
    df = spark.range(2000).selectExpr("cast(id % 2 as int) y", "round(length(repeat('x', cast(id as int))) / 4000, 6) s").repartition(2)
    lines = plan(classify.roc_points(df, "y", "s")).splitlines()
    assert not [x for x in lines if "Filter" in x and ("aggregate(" in x or "above(" in x)]
    points = classify.roc_points(df, "y", "s").collect()
    assert len(points) == 2000 and max(p["tp"] for p in points) == 1000


def test_postings_exchange_texts_not_words(spark):
    docs = spark.createDataFrame([(1, "a b a"), (1, "b c"), (None, "c c"), (3, None), (4, "!")], "d long, t string")
    index = search.postings(docs, "d", F.col("t"))
    assert "hashpartitioning(d#" in plan(index, "executedPlan") and ", term#" not in [x for x in plan(index, "executedPlan").splitlines() if "Exchange" in x][0]
    assert {tuple(r) for r in index.collect()} == {(1, "a", 2), (1, "b", 2), (1, "c", 1), (None, "c", 2)}
    placed = {(r["d"], r["term"]): (r["tf"], r["positions"]) for r in search.postings(docs, "d", F.col("t"), positions=True).collect()}
    assert placed == {(1, "a"): (2, [0, 2]), (1, "b"): (2, [0, 1]), (1, "c"): (1, [1]), (None, "c"): (2, [0, 1])}


def test_best_terms_are_the_same_however_many_terms_are_frequent(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{i * j % 17 % (j + 1)}" for j in range(40)) + f" own{i}") for i in range(60)], "d long, t string")
    index, n = search.postings(docs, "d", F.col("t")), docs.agg(F.count("*").alias("n"))
    wanted = sorted(map(tuple, search.top_terms(search.tfidf(index, n), "d", 5).select("d", "term", "w", "rank").collect()))
    for frequent in (0, 3, 1000):
        assert sorted(map(tuple, search.top_tfidf(index, "d", n, 5, frequent).select("d", "term", "w", "rank").collect())) == wanted


def test_sheets_are_counted_block_by_block(spark):
    lines = [x for k in range(30) for x in (f"{('Mon', 'Tue')[k % 2]}", "8:00 9:30 task", f"hours: {1 + k % 2}", *(["weekly: 3"] if k % 4 == 3 else []))]
    sheet = spark.createDataFrame([(i * 1000, x) for i, x in enumerate(lines)], "line_num long, text string").withColumn("file", F.lit("s"))
    days = lambda block: sorted(map(tuple, reports._sheet_days(sheet, "line_num", "text", "file", block).collect()))
    assert days(5000) == days(1 << 18) == days(1 << 40) and len(days(5000)) == 30 and max(r[1] for r in days(5000)) == 7
    windows = [x for x in plan(reports.timesheet(sheet)).splitlines() if "Window [" in x and "__n" in x]
    assert windows and all("__b" in x for x in windows)


def test_sentiment_exchanges_no_words(spark):
    words = [*"abcdef", "GOOD", "Bad", "not", "very", "but", "İx", "ẞ"]
    texts = [" ".join(words[(i * i + 3 * j * j + i * j) % len(words)] for j in range(i % 23)) + "!" * (i % 6) for i in range(80)] + [None, "", "?"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k long, text string").unionByName(spark.createDataFrame([(None, "very GOOD but bad")], "k long, text string"))
    lexicon = spark.createDataFrame([("good", 2.0), ("good", 1.9), ("bad", -2.5), ("a", 0.5), ("b", 0.0), (None, 1.0)], "word string, value double")
    boosters, negations = spark.createDataFrame([("very", 0.293), ("c", -0.293)], "word string, value double"), spark.createDataFrame([("not",), ("d",)], "word string")
    of = lambda **how: sentiment.compound(rows, "k", F.col("text"), lexicon, boosters, negations, **how)
    assert {tuple(r) for r in of().collect()} == {tuple(r) for r in of(sent=0).collect()} and of().count() == 84
    assert "Window" not in plan(of()) and "Join" not in plan(of())


def test_suggestions_are_those_of_all_pairs(spark):
    from random import Random

    rnd = Random(3)
    word = lambda n: "".join(rnd.choices("abcé", k=n))
    terms = {word(n) for n in range(2, 16) for _ in range(12)}
    asked = set(rnd.sample(sorted(terms), 30))
    for t in rnd.sample(sorted(terms), 90):
        for _ in range(rnd.randint(1, 4)):
            i = rnd.randrange(len(t) + 1)
            t = rnd.choice([t[:i] + word(1) + t[i:], t[:i] + t[i + 1 :], t[:i] + word(1) + t[i + 1 :]])
        asked.add(t)
    words, vocabulary = spark.createDataFrame([(w,) for w in sorted(asked)], "word string"), spark.createDataFrame([(t, 1 + len(t)) for t in sorted(terms)], "term string, df long")
    n = F.greatest(F.length("word"), F.length("term"))
    pairs = words.where(F.length("word") >= 4).crossJoin(vocabulary).where("word <> term").withColumn("distance", F.levenshtein("word", "term"))
    wanted = {(r["word"], r["term"]) for r in pairs.where(F.col("distance") <= 0.25 * n).collect()}
    found = {(r["word"], r["term"]) for r in spelling.suggest(words, vocabulary, k=1000).collect()}
    assert len(wanted) > 50 and (found - wanted, wanted - found) == (set(), set())


def test_texts_are_read_once_for_replacements(spark):
    from quern.plans import search as queries

    lines = plan(queries.spell_replacement(spark, "/root/testdata/sf0.001"))
    assert "documents.parquet" not in lines and "n_chars" not in lines and "__t" not in lines
