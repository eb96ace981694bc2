import random

import pytest

import __spark_entry__


def test_values_that_cancel_out_and_texts_without_words_agree_with_sql(spark, tmp_path):
    duckdb = pytest.importorskip("duckdb")
    rnd = random.Random(5)
    lexicon = [*(n * "x" + "y" for n in range(4, 13)), *(n * "v" + "w" for n in range(4, 13))]
    near = ["and", "a", "die", "of", "der", "la", "that", "AND", "DIE", "so"]
    texts = []
    for _ in range(6000):
        own = [rnd.choice(lexicon) for _ in range(rnd.randint(1, 3))]
        beside = [rnd.choice(near) for _ in range(rnd.randint(1, 3))]
        other = [rnd.choice([w for w in lexicon if (len(w) % 9 - 4) == 4 - len(x) % 9] or lexicon) for x in own]
        texts.append(" ".join([*beside, *own, "so", "so", "so", *beside, *other]) + "!" * rnd.randint(0, 4))
    texts += [None, "", "?!", "'", "and"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, " ".join(lexicon))], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    con.execute("SET threads = 1")
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet/*.parquet')")
    wanted = {d: (repr(c), n) for d, c, n in con.execute(__spark_entry__.oracle_sql()["compound_sentiment"]).fetchall()}
    found = {r["doc_id"]: (repr(r["compound"]), r["n_hits"]) for r in __spark_entry__.queries()["compound_sentiment"](spark, str(tmp_path)).collect()}
    assert len(wanted) == 6002 and {d: (found.get(d), wanted.get(d)) for d in wanted.keys() | found.keys() if found.get(d) != wanted.get(d)} == {}
