"""Queries of the index, search, TF-IDF, similarity and lookup operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions.scalars import ngrams, overlap
from quern.functions.text import words
from quern.operators import automaton, graph, lookup, query_language, similarity, spelling, text_index
from quern.operators import search as S
from quern.operators import tfidf as W
from quern.operators.tabular import filter_rows
from quern.plans.registry import DF, ITF, TF, WORDS, query, table

TEXT = "text"


def _n(docs):
    return docs.agg(F.count("*").alias("n"))


@query(f"""WITH {TF}, {DF}, n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, tf.term, round(tf * ln(n / df), 6) AS w FROM tf JOIN df USING (term), n)
SELECT doc_id, term, w, rank FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM w) WHERE rank <= 10""")
def tfidf_top_terms(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.top_tfidf(S.postings(docs, "doc_id", TEXT), "doc_id", _n(docs)).select("doc_id", "term", "w", "rank")


@query(f"WITH {TF}, {DF} SELECT term, df FROM df")
def doc_freq_terms(spark, sf_dir):
    return S.doc_freqs(S.postings(table(spark, sf_dir, "documents"), "doc_id", TEXT))


@query(f"WITH {TF} SELECT doc_id, term, tf FROM tf")
def doc_term_freqs(spark, sf_dir):
    return S.postings(table(spark, sf_dir, "documents"), "doc_id", TEXT)


@query(f"WITH {TF} SELECT count(DISTINCT term) AS n_terms, (SELECT count(*) FROM documents) AS n_docs, sum(tf)::BIGINT AS n_tokens FROM tf")
def term_count(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    stats = S.postings(docs, "doc_id", TEXT).groupBy("term").agg(F.sum("tf").alias("tf")).agg(F.count("*").alias("n_terms"), F.sum("tf").alias("n_tokens"))
    return stats.crossJoin(F.broadcast(docs.agg(F.count("*").alias("n_docs"))))  # one row each


_HITS = "h AS (SELECT tf.*, df FROM tf JOIN df USING (term) WHERE term IN ('licensed', 'license', 'apache')), n AS (SELECT count(*) AS n FROM documents)"


@query(f"WITH {TF}, {DF}, {_HITS} SELECT doc_id, count(*) AS n_terms, round(sum(tf * ln(n / df)), 6) AS score FROM h, n GROUP BY doc_id")
def search_or(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.search(S.postings(docs, "doc_id", TEXT), "doc_id", ["licensed", "license", "apache"], _n(docs))


@query(f"WITH {TF}, {DF}, {_HITS} SELECT doc_id, count(*) AS n_terms, round(sum(tf * ln(n / df)), 6) AS score FROM h, n GROUP BY doc_id HAVING count(*) = 3")
def search_and(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.search(S.postings(docs, "doc_id", TEXT), "doc_id", ["licensed", "license", "apache"], _n(docs), every=True)


@query(f"""WITH {TF}, {DF}, {_HITS}, s AS (SELECT doc_id, count(*) AS n_terms, round(sum(tf * ln(n / df)), 6) AS score FROM h, n GROUP BY doc_id)
SELECT doc_id, score, rank FROM (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 50""")
def search_top_hits(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = S.search(S.postings(docs, "doc_id", TEXT), "doc_id", ["licensed", "license", "apache"], _n(docs))
    return S.top_hits(found, "doc_id", 50).select("doc_id", "score", "rank")


_PHRASE = f"""WITH w AS (SELECT doc_id, {WORDS} AS w FROM documents),
p AS (SELECT doc_id, len(list_filter(range(1, len(w)), lambda i: w[i] = 'general' AND w[i + 1] = 'public')) AS n_hits FROM w)
SELECT doc_id, n_hits FROM p WHERE n_hits > 0"""


@query(_PHRASE)
def search_phrase(spark, sf_dir):
    return S.search_phrase(table(spark, sf_dir, "documents"), "doc_id", TEXT, ["general", "public"])


@query(_PHRASE)
def search_phrase_positions(spark, sf_dir):
    index = S.postings(table(spark, sf_dir, "documents"), "doc_id", TEXT, positions=True)
    return S.phrase_by_positions(index, "doc_id", ["general", "public"])


@query(f"""WITH {TF}, {DF}, w AS (SELECT doc_id, tf.term, round(tf * ln((SELECT count(*) FROM documents) / df), 6) AS w FROM tf JOIN df USING (term)),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM w QUALIFY rank <= 10), b AS (SELECT DISTINCT unnest({WORDS}) AS term FROM benchmark)
SELECT doc_id, term, term IN (SELECT term FROM b) AS listed FROM r""")
def keyword_filter(spark, sf_dir):
    """The documents' best terms, those of the benchmark's words (listed) and the others apart."""
    top = tfidf_top_terms(spark, sf_dir).select("doc_id", "term")
    listed = table(spark, sf_dir, "benchmark").select(F.explode(words(TEXT)).alias("word"))
    one = lambda flag: filter_rows(top, F.col("term"), listed, "word", exclude=not flag).withColumn("listed", F.lit(flag))
    return one(True).unionByName(one(False))


@query(f"""WITH {TF}, {DF}, s AS (SELECT doc_id, count(*) AS n_terms, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM tf JOIN df USING (term) WHERE term IN ('apache', 'license', 'mit') GROUP BY 1)
SELECT doc_id, n_terms, score, row_number() OVER (ORDER BY score, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 50""")
def search_reversed(spark, sf_dir):
    """The 50 hits of lowest score."""
    docs = table(spark, sf_dir, "documents")
    return S.top_hits(S.search(S.postings(docs, "doc_id", TEXT), "doc_id", ["apache", "license", "mit"], _n(docs)), "doc_id", 50, reverse=True)


@query(f"WITH {TF} SELECT term, count(*) AS hits FROM tf WHERE term IN ('the', 'der', 'le', 'license') GROUP BY term")
def hit_count(spark, sf_dir):
    index = S.postings(table(spark, sf_dir, "documents"), "doc_id", TEXT)
    return index.where(F.col("term").isin("the", "der", "le", "license")).groupBy("term").agg(F.count("*").alias("hits"))


_LINE = 'apache +license -"general public"'


@query(f"""WITH {TF}, {DF}, n AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id, {WORDS} AS w FROM documents),
x AS (SELECT doc_id FROM w WHERE len(list_filter(range(1, len(w)), lambda i: w[i] = 'general' AND w[i + 1] = 'public')) > 0)
SELECT doc_id, count(*) AS n_clauses, round(sum(tf * ln(n / df)), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('apache', 'license') AND doc_id NOT IN (SELECT doc_id FROM x) GROUP BY doc_id HAVING count_if(term = 'license') > 0""")
def search_query_line(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.run_query(S.field_index(docs, "doc_id", {"text": F.col(TEXT)}), "doc_id", _LINE, docs.count())


@query(f"""WITH {TF}, {DF}, n AS (SELECT count(*) AS n FROM documents), s AS (SELECT tf.doc_id, count(*) AS n_clauses, round(sum(tf * ln(n / df)), 6) AS score FROM tf JOIN df USING (term), n WHERE term IN ('apache', 'license') GROUP BY 1)
SELECT doc_id, n_clauses FROM s WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')""")
def search_fields(spark, sf_dir):
    """A word of the language field is required beside words of the text."""
    docs = table(spark, sf_dir, "documents")
    index = S.field_index(docs, "doc_id", {"text": F.col(TEXT), "lang": F.col("lang")})
    found = S.run_query(index, "doc_id", "+lang:en apache license", docs.count())
    return found.where("n_clauses > 1").select("doc_id", (F.col("n_clauses") - 1).alias("n_clauses"))


@query(f"""WITH {TF}, {DF}, n AS (SELECT count(*) AS n FROM documents),
w AS (SELECT doc_id, tf.term, round(tf * ln(n / df), 6) AS w FROM tf JOIN df USING (term), n),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM w) WHERE rank <= 10)
SELECT term, count(*) AS docs, round(avg(w), 4) AS mean_w FROM t GROUP BY term""")
def tfidf_report(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.keyword_report(S.top_tfidf(S.postings(docs, "doc_id", TEXT), "doc_id", _n(docs)))


@query(f"""WITH {TF}, {DF}, n AS (SELECT count(*) AS n FROM documents), w AS (SELECT doc_id, tf.term, round(tf * ln(n / df), 6) AS w FROM tf JOIN df USING (term), n),
t AS (SELECT doc_id, list_sort(list(term)) AS t FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY w DESC, term) AS rank FROM w) WHERE rank <= 10 GROUP BY 1),
s AS (SELECT array_to_string(list_filter(t, lambda x, i: (mask >> (i - 1)) & 1 = 1), ' ') AS terms FROM t, range(3, 1024) r(mask) WHERE mask < (1 << len(t)) AND bit_count(mask) >= 2)
SELECT terms, count(*) AS docs FROM s GROUP BY 1 HAVING count(*) >= 5 ORDER BY 2 DESC, 1 LIMIT 25""")
def keyword_sets(spark, sf_dir):
    """The 25 most frequent sets of terms that are among the ten best of the same documents."""
    return S.keyword_sets(tfidf_top_terms(spark, sf_dir), "doc_id")


@query(f"WITH {TF}, {DF} SELECT term, df FROM df WHERE df >= 5 AND df <= 0.2 * (SELECT count(*) FROM documents)")
def keyword_freq_filter(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return S.in_frequency_range(S.doc_freqs(S.postings(docs, "doc_id", TEXT)), 5, 0.2, _n(docs))


# --- the stored index -----------------------------------------------------------------------------


def _stored(spark, sf_dir):
    """Documents of even ids as a first segment, the others appended, both merged."""
    docs = table(spark, sf_dir, "documents")
    index, fields = text_index.temporary_index(spark), {"text": F.col(TEXT)}
    index.build(docs.where("doc_id % 2 = 0"), "doc_id", fields)
    return index.append(docs.where("doc_id % 2 <> 0 OR doc_id IS NULL"), "doc_id", fields)


def _found(hits):
    return hits.withColumnRenamed("doc", "doc_id")


def _leaf_sql(name, rows, boost=1.0):
    return f"{name} AS (SELECT doc_id, tf * ln((SELECT count(*) FROM documents) / count(*) OVER ()) * {boost} AS s FROM ({rows}))"


def _word_sql(word):
    return f"SELECT doc_id, tf FROM tf WHERE term = '{word}'"


_WORD_LISTS = f"w AS (SELECT doc_id, {WORDS} AS w FROM documents)"
_OF_THE = "SELECT doc_id, count(*) AS tf FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM w) WHERE w[i] = 'of' AND w[i + 1] = 'the' GROUP BY 1"


@query(f"""WITH {TF}, {_WORD_LISTS}, {_leaf_sql("a", _word_sql("the"), 2)}, {_leaf_sql("b", _word_sql("der"))}, {_leaf_sql("c", _word_sql("ti"))}, {_leaf_sql("d", _OF_THE)},
g AS (SELECT doc_id, sum(s) AS s FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY 1), h AS (SELECT doc_id, 1.5 * sum(s) AS s FROM (SELECT * FROM c UNION ALL SELECT * FROM d) GROUP BY 1)
SELECT doc_id, round(g.s + h.s, 6) AS score FROM g JOIN h USING (doc_id) WHERE doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'les')""")
def query_nested(spark, sf_dir):
    """Brackets, boosts, a phrase and an excluded word over an index of two segments."""
    return _found(query_language.search(_stored(spark, sf_dir), '(the^2 OR der) AND (ti OR "of the")^1.5 -les'))


@query(f"""WITH {TF}, {_WORD_LISTS}, a AS (SELECT doc_id, i AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] = 'the'), b AS (SELECT doc_id, i - 1 AS v FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i] = 'of'),
u AS (SELECT * FROM a UNION SELECT * FROM b), {_leaf_sql("n", "SELECT doc_id, count(*) AS tf FROM u WHERE EXISTS (SELECT 1 FROM a WHERE a.doc_id = u.doc_id AND a.v BETWEEN u.v AND u.v + 3) AND EXISTS (SELECT 1 FROM b WHERE b.doc_id = u.doc_id AND b.v BETWEEN u.v AND u.v + 3) GROUP BY 1")},
{_leaf_sql("m", _word_sql("and"), 0.5)} SELECT doc_id, round(m.s + coalesce(n.s, 0), 6) AS score FROM m LEFT JOIN n USING (doc_id)""")
def query_proximity(spark, sf_dir):
    """A required word, and two others near each other; the segments are merged first."""
    return _found(query_language.search(_stored(spark, sf_dir).merge(), '"the of"~3 +and^0.5'))


@query(f"""WITH {TF}, {_leaf_sql("a", "SELECT doc_id, sum(tf) AS tf FROM tf WHERE levenshtein(translate(term, 'äöüßéèêàâçîïôûùëñáíóú', 'ABCDEFGHIJKLMNOPQRSTU'), 'thble') <= 1 GROUP BY 1")}, {_leaf_sql("b", "SELECT doc_id, sum(tf) AS tf FROM tf WHERE starts_with(term, 'erin') GROUP BY 1")}
SELECT doc_id, round(sum(s), 6) AS score FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE doc_id NOT IN (SELECT doc_id FROM tf WHERE term = 'la') GROUP BY 1""")
def query_fuzzy(spark, sf_dir):
    """Words spelled alike, words of a beginning, an excluded word."""
    return _found(query_language.search(_stored(spark, sf_dir), "thble~1 OR erin* NOT la"))


@query(f"""WITH {TF}, {DF}, s AS (SELECT doc_id, round(sum(tf * ln((SELECT count(*) FROM documents) / df)), 6) AS score FROM tf JOIN df USING (term) WHERE term IN ('the', 'and', 'ti', 'erin') GROUP BY 1)
SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id)::INTEGER AS rank FROM s QUALIFY rank <= 50""")
def query_top_hits(spark, sf_dir):
    """The 50 best of some words; blocks that can't hold one of them aren't read."""
    return _found(query_language.search(_stored(spark, sf_dir), "the and ti erin", k=50))


# --- weighting schemes ----------------------------------------------------------------------------

_COUNTS = f"""{ITF}, d AS (SELECT item_id, sum(tf) AS len, max(tf) AS max_tf FROM tf GROUP BY item_id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
c AS (SELECT tf.item_id, tf.term, tf, len, max_tf, df, (SELECT count(*) FROM benchmark) AS n, (SELECT max(df) FROM df) AS max_df FROM tf JOIN d USING (item_id) JOIN df USING (term))"""
_TF_SQL = {"basic": "tf / len", "freq": "tf::DOUBLE", "binary": "1.0", "log": "1 + ln(tf)", "norm_50": "0.5 + 0.5 * tf / max_tf"}
_IDF_SQL = {"basic": "ln(n / df)", "freq": "df::DOUBLE", "smooth": "ln(1 + n / df)", "max": "ln(max_df / (1 + df))", "prob": "CASE WHEN n > df THEN ln((n - df) / df) END"}


def _scheme(tf: str, idf: str):
    def run(spark, sf_dir):
        return W.weighted(W.ngram_counts(table(spark, sf_dir, "benchmark"), "item_id", TEXT), tf, idf).select("item_id", "term", "w")

    run.__name__ = f"tfidf_weight_{tf.replace('_', '')}_{idf}"
    query(f"WITH {_COUNTS} SELECT item_id, term, round(({_TF_SQL[tf]}) * ({_IDF_SQL[idf]}), 6) AS w FROM c")(run)


for _tf in W.TF:
    for _idf in W.IDF:
        _scheme(_tf, _idf)

_GRAMS = f"list_concat({WORDS}, list_transform(range(1, len({WORDS})), lambda i: array_to_string(({WORDS})[i:i+1], ' ')))"
_NCOUNTS = f"""tf AS (SELECT item_id, term, count(*) AS tf FROM (SELECT item_id, unnest({_GRAMS}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT item_id, sum(tf) AS len FROM tf GROUP BY item_id), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
w AS (SELECT tf.item_id, tf.term, round(tf / len * ln((SELECT count(*) FROM benchmark) / df), 6) AS w FROM tf JOIN d USING (item_id) JOIN df USING (term)),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY w DESC, term) AS rank FROM w) WHERE rank <= 20)"""


def _top_ngrams(spark, sf_dir):
    counts = W.ngram_counts(table(spark, sf_dir, "benchmark"), "item_id", TEXT, 1, 2)
    return S.top_terms(W.weighted(counts), "item_id", 20).select("item_id", "term", "w", "rank")


@query(f"WITH {_NCOUNTS} SELECT item_id, term, w, rank FROM r")
def tfidf_ngram(spark, sf_dir):
    return _top_ngrams(spark, sf_dir)


@query(f"WITH {_NCOUNTS} SELECT item_id, term, w, rank FROM r WHERE NOT EXISTS (SELECT 1 FROM r AS o WHERE o.item_id = r.item_id AND o.rank < r.rank AND contains(o.term, r.term))")
def ngram_subsumption_prune(spark, sf_dir):
    return W.prune_subsumed(_top_ngrams(spark, sf_dir), "item_id")


@query(f"""WITH {_NCOUNTS} SELECT item_id, term, w, rank FROM r WHERE NOT regexp_matches(term, '^[0-9\\s]*$') AND NOT EXISTS
(SELECT 1 FROM r AS o WHERE o.item_id = r.item_id AND o.rank < r.rank AND (contains(' ' || o.term || ' ', ' ' || r.term || ' ') OR contains(' ' || r.term || ' ', ' ' || o.term || ' ')))""")
def ngram_overlap_prune(spark, sf_dir):
    return W.prune_overlapping(_top_ngrams(spark, sf_dir), "item_id")


@query(f"""WITH w AS (SELECT item_id, {WORDS} AS w FROM benchmark), p AS (SELECT item_id, w[-6:] AS a, list_concat(w[-3:], w[1:3]) AS b FROM w)
SELECT item_id, coalesce(array_to_string(b[1:list_max(list_filter(range(1, least(len(a), len(b)) + 1), lambda k: a[len(a) - k + 1:] = b[1:k]))], ' '), '') AS shared FROM p""")
def term_overlap(spark, sf_dir):
    w = table(spark, sf_dir, "benchmark").select("item_id", words(TEXT).alias("w"))
    last = lambda n: F.slice("w", F.greatest(F.size("w") - n + 1, F.lit(1)), F.lit(n))
    return w.select("item_id", overlap(last(6), F.concat(last(3), F.slice("w", 1, 3))).alias("shared"))


@query(f"SELECT item_id, unnest({_GRAMS}) AS ngram FROM benchmark")
def ngram_generation(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", F.explode(ngrams(words(TEXT), 1, 2)).alias("ngram"))


# --- vectors --------------------------------------------------------------------------------------


@query(f"WITH {TF} SELECT doc_id, term, tf AS n FROM tf")
def bow_vectors(spark, sf_dir):
    return similarity.bag_of_words(table(spark, sf_dir, "documents"), "doc_id", TEXT)


@query(f"""WITH {TF}, {DF}, k AS (SELECT term FROM df WHERE df >= 3 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY df DESC, term LIMIT 500)
SELECT doc_id, term, tf AS n FROM tf SEMI JOIN k USING (term)""")
def dictionary_pruning(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return similarity.prune_dictionary(similarity.bag_of_words(docs, "doc_id", TEXT), 3, 0.5, _n(docs), 500)


_VECTORS = f"""{TF}, {DF}, v AS (SELECT doc_id, tf.term, tf * log2((SELECT count(*) FROM documents) / df) AS v FROM tf JOIN df USING (term)),
u AS (SELECT doc_id, term, v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)) AS w FROM v WHERE v > 0)"""


def _vectors(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return similarity.tfidf_vectors(similarity.bag_of_words(docs, "doc_id", TEXT), "doc_id", _n(docs))


def _hashed(spark, sf_dir):
    return similarity.hashed_vectors(table(spark, sf_dir, "documents"), "doc_id", F.col(TEXT))


@query(f"WITH {_VECTORS} SELECT doc_id, term, round(w, 6) AS w FROM u")
def tfidf_vectors(spark, sf_dir):
    return _vectors(spark, sf_dir).withColumn("w", F.round("w", 6))


@query(f"""WITH {_VECTORS}, q AS (SELECT doc_id AS query, term, w AS qw FROM u WHERE doc_id % 50 = 0),
s AS (SELECT query, doc_id, round((sum(qw * w) + 1) / 2, 6) AS score FROM q JOIN u USING (term) WHERE query <> doc_id GROUP BY ALL)
SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10""")
def cosine_similar_docs(spark, sf_dir):
    """Queries are the documents whose id 50 divides; they meet all others."""
    queries = table(spark, sf_dir, "documents").where("doc_id % 50 = 0").select("doc_id")
    return similarity.similar_docs(_hashed(spark, sf_dir), queries, "doc_id").select("query", "doc_id", "score", "rank")


@query()
def all_similar_docs(spark, sf_dir):
    """For every document up to ten others of a cosine of 0.8 or more; recall is measured in the tests."""
    return similarity.all_similar(_hashed(spark, sf_dir), "doc_id")


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS vn FROM v),
s AS (SELECT q.vec_id AS query, n.vec_id, round(list_dot_product(q.v, n.v) / (q.vn * n.vn), 6) AS score FROM n JOIN n AS q ON q.vec_id % 50 = 0 AND q.vec_id <> n.vec_id)
SELECT query, vec_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10""")
def embedding_topk(spark, sf_dir):
    """Queries are the vectors whose id 50 divides; they meet all others."""
    v = table(spark, sf_dir, "embeddings")
    return similarity.nearest_vectors(v, v.where("vec_id % 50 = 0"), "vec_id", "embedding").select("query", "vec_id", "score", "rank")


@query()
def lsa_topics(spark, sf_dir):
    return similarity.topics(table(spark, sf_dir, "benchmark"), "item_id", TEXT, 2, 1 << 18, 2)


# --- lookups --------------------------------------------------------------------------------------


@query("SELECT p_partkey, p_name FROM part WHERE starts_with(p_name, 'b')")
def prefix_lookup(spark, sf_dir):
    return lookup.find_prefix(table(spark, sf_dir, "part"), "p_name", "b").select("p_partkey", "p_name")


@query("""WITH k AS (SELECT DISTINCT p_type AS k FROM part), n AS (SELECT DISTINCT substr(k, 1, i) AS p FROM k, range(1, 200) t(i) WHERE i <= length(k))
SELECT (SELECT count(*) FROM k) AS n_entries, count(*) + 1 AS n_nodes FROM n""")
def trie_size(spark, sf_dir):
    return automaton.trie_nodes(table(spark, sf_dir, "part"), "p_type")


@query("""WITH q AS (SELECT p_partkey, string_split(p_name, ' ')[1] AS prefix FROM part), e AS (SELECT p_name, min(p_brand) AS brand FROM part GROUP BY 1)
SELECT p_partkey, p_name AS phrase, brand AS value FROM q JOIN e ON p_name = prefix OR starts_with(p_name, prefix || ' ')""")
def trie_prefix_find(spark, sf_dir):
    """For each part the names that begin with its own name's first word, with a brand."""
    parts = table(spark, sf_dir, "part")
    trie = automaton.load_trie(parts.select(F.col("p_name").alias("phrase"), F.col("p_brand").alias("value")))
    return automaton.entries_under(parts.select("p_partkey", F.substring_index("p_name", " ", 1).alias("prefix")), "p_partkey", "prefix", trie)


@query("WITH w AS (SELECT DISTINCT string_split(p_type, ' ') AS w FROM part) SELECT DISTINCT array_to_string(w[1:i], ' ') AS prefix FROM w, range(1, 50) t(i) WHERE i <= len(w)")
def phrase_prefixes(spark, sf_dir):
    return lookup.prefixes(table(spark, sf_dir, "part").select(F.split("p_type", " ").alias("w")).distinct(), "w")


@query("SELECT n_name, n_regionkey FROM nation WHERE NOT (n_regionkey = 1 AND starts_with(n_name, 'N'))")
def trie_delete(spark, sf_dir):
    return lookup.delete(table(spark, sf_dir, "nation").select("n_name", "n_regionkey"), "n_name", "n_regionkey", v=1, prefix="N")


@query(f"""WITH RECURSIVE i AS (SELECT item_id, {WORDS} AS w FROM benchmark), b AS (SELECT DISTINCT min(item_id::VARCHAR) OVER (PARTITION BY phrase) AS value, phrase FROM (SELECT item_id, array_to_string(w[a:a + n - 1], ' ') AS phrase FROM i, range(1, 100000) r(a), range(2, 5) t(n) WHERE a + n - 1 <= len(w))),
d AS (SELECT doc_id, {WORDS} AS w FROM documents), p AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS a FROM d),
g AS (SELECT doc_id, (a - 1)::INTEGER AS start, n::INTEGER AS n, array_to_string(w[a:a + n - 1], ' ') AS phrase FROM p, range(2, 5) t(n) WHERE a + n - 1 <= len(w)),
h AS (SELECT doc_id, start, max(g.n) AS n, arg_max(phrase, g.n) AS phrase, arg_max(value, g.n) AS value FROM g JOIN b USING (phrase) GROUP BY 1, 2),
r AS (SELECT doc_id, min(start) AS start FROM h GROUP BY 1 UNION ALL SELECT doc_id, nxt FROM (SELECT r.doc_id, (SELECT min(x.start) FROM h AS x WHERE x.doc_id = r.doc_id AND x.start >= r.start + y.n) AS nxt FROM r JOIN h AS y ON y.doc_id = r.doc_id AND y.start = r.start) WHERE nxt IS NOT NULL)
SELECT doc_id, start, n, phrase, value FROM h JOIN r USING (doc_id, start)""")
def phrase_spotting(spark, sf_dir):
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    grams = items.select("item_id", F.explode(ngrams(words(TEXT), 2, 4)).alias("phrase"))
    phrases = grams.select("phrase", F.col("item_id").cast("string").alias("value"))
    return lookup.spot_phrases(docs, "doc_id", words(TEXT), phrases)


_VOCAB = f"WITH {TF}, {DF}, b AS (SELECT DISTINCT unnest({WORDS}) AS word FROM benchmark)"


@query(f"{_VOCAB} SELECT word FROM b ANTI JOIN (SELECT term FROM df WHERE df >= 2) k ON word = term")
def misspelled_words(spark, sf_dir):
    vocabulary = spelling.vocabulary(S.postings(table(spark, sf_dir, "documents"), "doc_id", TEXT), 2)
    return spelling.unknown_words(table(spark, sf_dir, "benchmark").select(F.explode(words(TEXT)).alias("word")), vocabulary)


#: The edit distance of the SQL engine counts bytes, so letters beyond ASCII become capitals first, which no word holds.
_SINGLE = "translate({}, 'äöüßéèêàâçîïôûùëñáíóú', 'ABCDEFGHIJKLMNOPQRSTU')"
#: An edit changes at most two of the letters that a word has, here as bits, which tells most pairs apart at once.
_LETTERS = "list_bit_or(list_transform(string_split({}, ''), lambda c: 1::BIGINT << (unicode(c) % 62)))"
_SUGGEST = f"""{_VOCAB}, v AS MATERIALIZED (SELECT term, df, length(term) AS tn, {_LETTERS.format("term")} AS tl FROM df WHERE df >= 3 AND length(term) >= 2),
s AS MATERIALIZED (SELECT word, length(word) AS wn, {_LETTERS.format("word")} AS wl FROM b WHERE length(word) >= 4 AND NOT regexp_matches(word, '^[0-9]')),
m0 AS MATERIALIZED (SELECT word, term, df, greatest(wn, tn) AS n FROM s JOIN v ON tn BETWEEN wn - wn // 3 AND wn + wn // 3 WHERE word <> term AND 2 * bit_count(xor(wl, tl)) <= greatest(wn, tn)),
c AS (SELECT word, term, df, levenshtein({_SINGLE.format("word")}, {_SINGLE.format("term")}) AS distance, n FROM m0),
g AS MATERIALIZED (SELECT word, term, df, distance, round(1 - distance / n, 6) AS similarity FROM c WHERE distance <= 0.25 * n),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY word ORDER BY similarity DESC, df DESC, term) AS rank FROM g)"""


@query(f"""{_VOCAB}, p AS (SELECT word, word || 's' AS term FROM b UNION SELECT word, reverse(word) FROM b), r AS (SELECT word, left(word, 3) AS root FROM b)
SELECT word, term, term = word || 's' OR word = term || 's' OR coalesce((SELECT min(root) FROM r WHERE r.word = p.word) = (SELECT min(root) FROM r WHERE r.word = p.term), false) AS variant FROM p""")
def spelling_variants(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select(F.explode(words(TEXT)).alias("word")).distinct()
    pairs = b.select("word", F.concat("word", F.lit("s")).alias("term")).union(b.select("word", F.reverse("word"))).distinct()
    return spelling.variants(pairs, "word", "term", roots=b.select("word", F.substr("word", F.lit(1), F.lit(3)).alias("root")))


@query("""WITH s AS (SELECT DISTINCT p_name AS word, p_type AS synset FROM part) SELECT DISTINCT a.word, b.word AS synonym FROM s AS a JOIN s AS b USING (synset) WHERE a.word <> b.word""")
def synonyms(spark, sf_dir):
    return graph.synonyms(table(spark, sf_dir, "part").select(F.col("p_name").alias("word"), F.col("p_type").alias("synset")).distinct())


def _suggested(spark, sf_dir):
    graph.checkpoint_dir(spark)
    freqs = spelling.vocabulary(S.postings(table(spark, sf_dir, "documents"), "doc_id", TEXT)).checkpoint()  # the texts are read once
    return freqs, spelling.suggest(table(spark, sf_dir, "benchmark").select(F.explode(words(TEXT)).alias("word")), freqs.where("df >= 3"))


@query(f"{_SUGGEST} SELECT word, term, distance, similarity, rank FROM r WHERE rank <= 5")
def spell_suggest(spark, sf_dir):
    return _suggested(spark, sf_dir)[1].select("word", "term", F.col("distance").cast("long").alias("distance"), "similarity", F.col("rank").cast("long").alias("rank"))


@query(f"""{_SUGGEST}, t AS (SELECT * FROM r WHERE rank <= 5 AND NOT (term = word || 's' OR word = term || 's')),
m AS (SELECT word, arg_max(term, (df, term)) AS replacement, max(df) AS df FROM t GROUP BY word)
SELECT word, replacement, round(m.df / greatest(coalesce(o.df, 0), 1), 6) AS gain FROM m LEFT JOIN df AS o ON m.word = o.term WHERE coalesce(o.df, 0) <= 10 AND m.df / greatest(coalesce(o.df, 0), 1) >= 3""")
def spell_replacement(spark, sf_dir):
    freqs, found = _suggested(spark, sf_dir)
    return spelling.replacement(found, freqs)
