import random

from pyspark.sql import functions as F

from quern.operators import automaton, lookup


def some_phrases(rnd, n):
    return sorted({" ".join(rnd.choice("abcde") for _ in range(rnd.randint(1, 5))) for _ in range(n)})


def test_trie_finds_what_is_there():
    rnd = random.Random(1)
    phrases = some_phrases(rnd, 200)
    trie = automaton.compile_trie(phrases, [p.upper() for p in phrases])
    for words in (*phrases, *some_phrases(rnd, 200), "a b c d e a", "z", ""):
        assert trie.find(words) == (words.upper() if words in phrases else None)
        below = sorted(p for p in phrases if p == words or p.startswith(words + " ") or not words)
        assert sorted(p for p, _ in trie.under(words)) == below and (trie.node(words) is None) == (not below)
    assert trie.n_nodes == 1 + len({tuple(p.split(" ")[:k]) for p in phrases for k in range(1, len(p.split(" ")) + 1)})
    empty = automaton.compile_trie([], [])
    assert empty.n_nodes == 1 and empty.find("a") is None and empty.under("a") == []


def test_spotting_by_trie_and_by_join(spark):
    rnd = random.Random(2)
    table = spark.createDataFrame([(p, str(k % 7)) for k, p in enumerate(some_phrases(rnd, 60) * 2)], "phrase string, value string")
    docs = spark.createDataFrame([(k, " ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(0, 60)))) for k in range(30)] + [(31, None), (None, "a b")], "doc long, text string").repartition(3)
    own = F.filter(F.split("text", " "), lambda w: w != "")
    found = [sorted(map(str, (tuple(r) for r in lookup.spot_phrases(docs, "doc", own, table, compiled=c).collect()))) for c in (1 << 20, 0)]
    assert found[0] == found[1] and len(found[0]) > 100


def test_nodes_over_ranges(spark):
    rnd = random.Random(3)
    keys = ["".join(rnd.choices("abcä𐍈", k=rnd.randint(0, 6))) for _ in range(500)] + [None]
    nodes = {k[:n] for k in keys if k for n in range(1, len(k) + 1)}
    out = automaton.trie_nodes(spark.createDataFrame([(k,) for k in keys], "k string").repartition(7), "k").first()
    assert tuple(out) == (len(set(keys) - {None}), 1 + len(nodes))
    assert tuple(automaton.trie_nodes(spark.createDataFrame([], "k string"), "k").first()) == (0, 1)


def test_entries_under_prefixes(spark):
    phrases = spark.createDataFrame([("a b", "1"), ("a b c", "2"), ("a bc", "3"), ("b", None), (None, "x"), ("a b", "0")], "phrase string, value string")
    asked = spark.createDataFrame([(1, "a b"), (2, "a"), (3, "c"), (4, None), (5, "b")], "k long, prefix string")
    trie = automaton.load_trie(phrases)
    out = sorted(map(tuple, automaton.entries_under(asked, "k", "prefix", trie).collect()))
    assert out == [(1, "a b", "0"), (1, "a b c", "2"), (2, "a b", "0"), (2, "a b c", "2"), (2, "a bc", "3"), (5, "b", None)]
    assert automaton.load_trie(phrases, 10) is None
