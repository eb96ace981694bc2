from pyspark.sql import functions as F

from quern.sources import readers, writers
from quern.streaming import lines as streaming


def lines(spark, *text):
    return spark.createDataFrame([(t,) for t in text], "value string")


def test_numbered(spark):
    df = readers.numbered(spark.range(1000).repartition(7).select(F.col("id").cast("string").alias("value")))
    assert sorted(r["line_num"] for r in df.collect()) == list(range(1, 1001))


def test_tables(spark):
    kv = readers.key_values(lines(spark, "A\t1\tx", "none", "a\t2"))
    assert [tuple(r) for r in kv.collect()] == [("a", "2")]
    assert {r[0] for r in readers.indicators(lines(spark, " A ", "a", "b", "")).collect()} == {"a", "b"}
    assert [tuple(r) for r in readers.multimap(lines(spark, "k\t1\t2", "k\t3", "z")).collect()] == [("k", ["1", "2", "3"])]
    assert [tuple(r) for r in readers.two_fields(lines(spark, "a\tb", "a\tb\tc")).collect()] == [("a", "b")]
    p = readers.phrases(lines(spark, "new  york\tcity", "x", " ".join(["w"] * 26))).orderBy("phrase").collect()
    assert [(r["phrase"], r["n"], r["value"]) for r in p] == [("new york", 2, "city"), ("x", 1, "True")]
    assert [tuple(r) for r in readers.rewrite_rules(lines(spark, "a => b, c", "d")).collect()] == [("a", ["b", "c"])]
    f = readers.frequencies(lines(spark, "# c", "Dog\tNN\t5", "dog\t9"))
    assert [tuple(r) for r in f.collect()] == [("dog", 5.0, "NN")]
    assert [tuple(r) for r in readers.labelled_texts(lines(spark, "POS\tgood", "x")).collect()] == [("pos", "good")]
    assert readers.without_comments(lines(spark, "# a", "; b", "", "c")).count() == 1


def test_files(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "n string, v int")
    writers.write_lines(df, str(tmp_path / "t"))
    assert sorted(r[0] for r in readers.read_lines(spark, str(tmp_path / "t")).collect()) == ["a\t1", "b\t2"]
    writers.write_by_name(df, "n", str(tmp_path / "n"))
    assert (tmp_path / "n" / "n=a").is_dir()
    (tmp_path / "u16.txt").write_bytes("ä\nb\n".encode("utf-16"))
    assert [r[0] for r in readers.read_lines(spark, str(tmp_path / "u16.txt"), "UTF-16").collect()] == ["ä", "b"]
    (tmp_path / "c.csv").write_text('x,y\n"1,5",2\n# no\n')
    assert [tuple(r) for r in readers.read_delimited(spark, str(tmp_path / "c.csv"), ",", comment="#").collect()] == [("1,5", "2")]
    assert readers.read_files(spark, str(tmp_path / "*.csv")).first()["size"] == 17
    (tmp_path / "w.xml").write_text("<m><page><title>Dog</title><revision><text>My dog!</text></revision></page><page><title>Template:x</title><revision><text>n</text></revision></page></m>")
    assert [tuple(r) for r in readers.wiki_pages(spark, str(tmp_path / "w.xml")).collect()] == [("Dog", "my dog")]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("1\n2\n3\n")
    stream = streaming.read_line_stream(spark, str(tmp_path / "in"))
    streaming.run_available(stream, lambda d: d.where("value <> '2'"), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(r[0] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["1", "3"]


def test_sequences_and_hooks(spark, tmp_path):
    codes = readers.timed_codes(lines(spark, "A1, 2001-01-01, x", "a1,1/2/2001,", "bad"))
    assert [tuple(r) for r in codes.collect()] == [("a1", 978307200, "x")]
    assert [r[0] for r in readers.spaced_fields(lines(spark, " a  b ", "-----")).collect()] == [["a", "b"]]
    (tmp_path / "d.bin").write_bytes(b"abc")
    assert readers.extracted_texts(spark, str(tmp_path / "d.bin"), lambda b: bytes(b).decode().upper()).first()["text"] == "ABC"
    assert readers.fetched(lines(spark, "u"), lambda u: u * 2, "value").first()["body"] == "uu"


def test_layouts_of_examples(spark):
    cells = spark.createDataFrame([tuple(f"x{k}" for k in range(10))], ", ".join(f"_c{k} string" for k in range(10)))
    expected = {"cola": ("x3", None, "x1"), "mrpc": ("x3", "x4", "x0"), "mnli": ("x8", "x9", "x9"), "xnli": ("x6", "x7", "x1"), "multi": ("x3", None, "x1")}
    for layout, (a, b, label) in expected.items():
        r = readers.examples(cells, layout).first()
        assert (r["guid"], r["text_a"], r["text_b"], r["label"]) == ("x0", a, b, label)


def test_named_rows(spark, tmp_path):
    df = spark.createDataFrame([(f"n{k}", k, "x" if k % 2 else None) for k in range(300)], "name string, a int, b string")
    writers.write_rows(df, "name", str(tmp_path / "rows"), 3)
    assert len(list((tmp_path / "rows").glob("*.parquet"))) <= 3
    assert readers.read_rows(spark, str(tmp_path / "rows")).count() == 300
    found = {r["name"]: r["content"] for r in readers.read_rows(spark, str(tmp_path / "rows"), ["n7", "n8", "none"]).collect()}
    assert found == {"n7": "7 x", "n8": "8"}
