"""The pipeline: every stage's decisions on a small corpus."""

import random

import corpus_pipeline


def test_stages(spark, tmp_path):
    rnd = random.Random(2)
    words = {"en": "the and of with which this there would about people house river".split(), "de": "der und nicht eine durch werden schön über auch zwischen haus fluss".split()}
    text = lambda lang, k: " ".join(rnd.choice(words[lang]) + rnd.choice("abcdefghij") * rnd.randint(0, 2) for _ in range(k)) + "."
    rows = []
    for i in range(80):
        lang = "en" if i % 2 else "de"
        rows.append((i, text(lang, 40) + "\n" + text(lang, 30) + (f"\nVisited {i} times since day {i} of this year" if i < 20 else ""), lang, f"src{i % 4}", 0))
    rows.append((80, "1234 5678 --- 9", "en", "src1", 5))
    rows.append((81, rows[41][1], "en", "src1", 5))
    item = text("en", 25)
    rows.append((82, text("en", 40) + " " + item, "en", "src2", 5))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "ngram_join", "decontamination", "mixing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        seen[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns or name == "mixing"
    assert set(seen["language_id"]) == set(range(83)) - {80}
    assert all("Visited" not in t for t in seen["line_dedup"].values()) and len(seen["line_dedup"]) == 82
    assert set(seen["ngram_join"]) == set(seen["line_dedup"]) - {81}
    assert set(seen["decontamination"]) == set(seen["ngram_join"]) - {82}
    assert set(seen["mixing"]) <= set(seen["decontamination"]) and len(seen["mixing"]) > 20
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, folder).collect()} == set(seen["mixing"])


def test_near_copies(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    words = [f"w{k}" for k in range(100)]
    edited = ["x" if k in (30, 60) else w for k, w in enumerate(words)]  # 5-word Jaccard 86/106, 3-word 92/104
    docs = spark.createDataFrame([(i, " ".join(w), "en", "s", 0) for i, w in enumerate((words, edited))], schema)
    assert [r["doc_id"] for r in corpus_pipeline.dedup_documents(spark, docs, "").collect()] == [0]


def test_short_lines(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(i, " ".join(f"{x}{chr(97 + i)}" for x in "abcdefghij") + "\nAll rights reserved.", "en", "s", 0) for i in range(9)]
    assert not any("rights" in r["text"] for r in corpus_pipeline.dedup_lines(spark, spark.createDataFrame(rows, schema), "").collect())
