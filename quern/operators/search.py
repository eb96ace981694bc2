"""An inverted index as a table of postings, queries over it, and TF-IDF."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.operators.graph import checkpoint_dir


def postings(docs: DataFrame, doc: str, text: Column, positions: bool = False) -> DataFrame:
    """(doc, term, tf[, positions]) of the lower-cased words. Without positions the texts are exchanged once, by
    document, and counted row by row: a document's words are sorted, and each run of equal ones is a term."""
    if positions:
        at = docs.select(doc, F.posexplode(words(text)).alias("pos", "term"))
        return at.groupBy(doc, "term").agg(F.count("*").alias("tf"), F.array_sort(F.collect_list("pos")).alias("positions"))
    texts = docs.select(doc, (F.col(text) if isinstance(text, str) else text).alias("__t")).groupBy(doc).agg(F.collect_list("__t").alias("__t"))
    sorted_words = texts.select(doc, F.sort_array(F.flatten(F.transform("__t", lambda t: words(t)))).alias("__w"))
    begins = F.array_compact(F.transform("__w", lambda x, i: F.when((i == 0) | (x != F.get("__w", i - 1)), i)))
    runs = F.transform("__b", lambda p, k: F.struct(F.get("__w", p).alias("term"), (F.coalesce(F.get("__b", k + 1), F.size("__w")) - p).cast("long").alias("tf")))
    each = sorted_words.select(doc, "__w", begins.alias("__b")).select(doc, F.inline_outer(runs))
    return each.where(F.col("term").isNotNull())  # `inline` alone makes a filter that works out every array once more, below


def field_index(docs: DataFrame, doc: str, fields: dict[str, Column]) -> DataFrame:
    """(doc, field, term, tf, positions) of the lower-cased words of every field."""
    parts = [postings(docs, doc, text, positions=True).withColumn("field", F.lit(name)) for name, text in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(doc, "field", "term", "tf", "positions")


def write_index(index: DataFrame, path: str) -> None:
    """Stores an index in folders by field, sorted by term, so that a query reads the row groups of its terms only."""
    index.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.mode("overwrite").partitionBy("field").parquet(path)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


@dataclass(frozen=True)
class Clause:
    """A word, prefix (`word*`) or quoted phrase in a field; must and must_not as in `+word` and `-word`."""

    field: str
    words: tuple[str, ...]
    prefix: bool = False
    must: bool = False
    must_not: bool = False


def parse_query(line: str, field: str = "text", conjunctive: bool = False) -> list[Clause]:
    """Clauses of `word`, `+word`, `-word`, `NOT word`, `word AND word`, `"a phrase"`, `word*` and `field:word`; others
    are alternatives, or with conjunctive all required."""
    out: list[Clause] = []
    both = negate = False
    for sign, name, phrase, word in re.findall(r'([+-]?)(?:(\w+):)?(?:"([^"]*)"|([^\s"]+))', line):
        if word in ("AND", "&&") and not sign and not name:
            both = True
            if out and not out[-1].must_not:
                out[-1] = Clause(out[-1].field, out[-1].words, out[-1].prefix, True)
            continue
        if word in ("OR", "||") and not sign and not name:
            continue
        if word in ("NOT", "!") and not sign and not name:
            negate = True
            continue
        words_ = tuple(re.findall(r"\w+", (phrase or word).lower()))
        if words_:
            must_not = sign == "-" or negate
            out.append(Clause(name or field, words_, word.endswith("*") and len(words_) == 1, not must_not and (sign == "+" or both or conjunctive), must_not))
        both = negate = False
    return out


def run_query(index: DataFrame, doc: str, line: str, n_docs: int, field: str = "text", conjunctive: bool = False) -> DataFrame:
    """(doc, n_clauses, score) of the documents that a query line finds in a field index, scored by the sum of TF-IDF.

    Every clause reads its terms' postings only; a phrase joins the positions of its words, shifted by their places.
    """
    clauses = parse_query(line, field, conjunctive)
    hits = None
    for k, c in enumerate(clauses):
        own = index.where(F.col("field") == c.field)
        if c.prefix:
            met = own.where(F.startswith("term", F.lit(c.words[0]))).groupBy(doc).agg(F.sum("tf").alias("tf"))
        elif len(c.words) == 1:
            met = own.where(F.col("term") == c.words[0]).select(doc, "tf")
        else:
            met = phrase_by_positions(own, doc, list(c.words)).select(doc, F.col("n_hits").alias("tf"))
        met = met.select(doc, F.lit(k).alias("clause"), "tf")
        hits = met if hits is None else hits.unionByName(met)
    if hits is None:
        return index.select(doc, F.lit(0).cast("long").alias("n_clauses"), F.lit(0.0).alias("score")).where(F.lit(False))
    must, must_not = [k for k, c in enumerate(clauses) if c.must], [k for k, c in enumerate(clauses) if c.must_not]
    df = hits.groupBy("clause").agg(F.count("*").alias("df"))  # a row a clause
    weighed = hits.join(F.broadcast(df), "clause").withColumn("w", F.col("tf") * F.log(F.lit(n_docs) / F.col("df")))
    is_in = lambda ks: F.col("clause").isin(ks) if ks else F.lit(False)
    found = weighed.groupBy(doc).agg(F.count_if(~is_in(must_not)).alias("n_clauses"), F.count_if(is_in(must)).alias("required"), F.count_if(is_in(must_not)).alias("refused"), F.round(F.sum(F.when(~is_in(must_not), F.col("w"))), 6).alias("score"))
    return found.where((F.col("n_clauses") > 0) & (F.col("required") == len(must)) & (F.col("refused") == 0)).select(doc, "n_clauses", "score")


def doc_freqs(index: DataFrame) -> DataFrame:
    return index.groupBy("term").agg(F.count("*").alias("df"))


def tfidf(index: DataFrame, n_docs: DataFrame) -> DataFrame:
    """index with df, idf and w = round(tf * ln(N / df), 6). n_docs: one row (n)."""
    return index.join(doc_freqs(index), "term").crossJoin(F.broadcast(n_docs)).withColumn("idf", F.log(F.col("n") / F.col("df"))).withColumn("w", F.round(F.col("tf") * F.col("idf"), 6))  # one row


def top_terms(weighted: DataFrame, doc: str, k: int = 10, weight: str = "w") -> DataFrame:
    """The k terms of highest weight of each document, ties by term, with rank."""
    w = Window.partitionBy(doc).orderBy(F.desc(weight), "term")
    weighted = weighted.repartition(doc)  # a document's terms lie scattered, so they are sorted after the exchange only
    return weighted.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


#: Terms whose document frequencies travel to every task.
FREQUENT = 1 << 16


def top_tfidf(index: DataFrame, doc: str, n_docs: DataFrame, k: int = 10, frequent: int = FREQUENT) -> DataFrame:
    """top_terms of tfidf. The `frequent` most frequent terms are weighed where the documents lie; of these a document's k
    best only, and all rarer terms, meet their frequencies by an exchange, so most postings are in none."""
    freqs = doc_freqs(index)
    often = freqs.orderBy(F.desc("df"), "term").limit(frequent).select("term", F.col("df").alias("__df"))  # bounded
    known = index.join(F.broadcast(often), "term", "left").crossJoin(F.broadcast(n_docs))  # one row
    order = Window.partitionBy(doc).orderBy(F.col("__w").desc_nulls_last(), "term")
    ranked = known.withColumn("__w", F.round(F.col("tf") * F.log(F.col("n") / F.col("__df")), 6)).withColumn("__r", F.row_number().over(order))
    kept = ranked.where((F.col("__r") <= k) | F.col("__df").isNull()).select(*index.columns, "n")
    met = kept.join(freqs, "term").withColumn("idf", F.log(F.col("n") / F.col("df")))
    return top_terms(met.withColumn("w", F.round(F.col("tf") * F.col("idf"), 6)), doc, k)


def search(index: DataFrame, doc: str, terms: list[str], n_docs: DataFrame, every: bool = False) -> DataFrame:
    """(doc, n_terms, score): documents with any (or every) term, scored by the sum of TF-IDF."""
    wanted = sorted(set(terms))
    hits = index.where(F.col("term").isin(*wanted))
    scored = hits.join(doc_freqs(hits), "term").crossJoin(F.broadcast(n_docs))  # one row
    out = scored.groupBy(doc).agg(F.count("*").alias("n_terms"), F.round(F.sum(F.col("tf") * F.log(F.col("n") / F.col("df"))), 6).alias("score"))
    return out.where(F.col("n_terms") == len(wanted)) if every else out


def search_phrase(docs: DataFrame, doc: str, text: Column, phrase: list[str]) -> DataFrame:
    """(doc, n_hits): documents with the phrase; words next to each other on the padded word string."""
    padded = F.concat(F.lit(" "), F.array_join(words(text), "  "), F.lit(" "))
    needle = " " + "  ".join(w.lower() for w in phrase) + " "
    found = docs.select(doc, padded.alias("p")).where(F.contains("p", F.lit(needle)))
    return found.select(doc, F.floor((F.length("p") - F.length(F.replace("p", F.lit(needle), F.lit("")))) / len(needle)).cast("long").alias("n_hits"))


def phrase_by_positions(index: DataFrame, doc: str, phrase: list[str]) -> DataFrame:
    """(doc, n_hits) from an index with positions: positions shifted by their place in the phrase meet."""
    places = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(phrase)])
    rows = index.where(F.col("term").isin(*set(phrase))).select(doc, "term", "positions", F.explode(places).alias("x")).where("term = x.w")
    starts = rows.select(doc, F.explode("positions").alias("p"), "x.i").select(doc, (F.col("p") - F.col("i")).alias("start"), "i")
    return starts.groupBy(doc, "start").agg(F.count("*").alias("n")).where(F.col("n") == len(phrase)).groupBy(doc).agg(F.count("*").alias("n_hits"))


def top_hits(scored: DataFrame, doc: str, k: int = 50, reverse: bool = False) -> DataFrame:
    """The k best, with rank."""
    best = scored.orderBy(F.asc("score") if reverse else F.desc("score"), doc).limit(k)  # k rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.asc("score") if reverse else F.desc("score"), doc)))


def keyword_report(top: DataFrame) -> DataFrame:
    """(term, docs, mean_w): over how many documents a top term is spread."""
    return top.groupBy("term").agg(F.count("*").alias("docs"), F.round(F.avg("w"), 4).alias("mean_w"))


#: Terms whose sets give the first bound; any number is right.
FIRST_TERMS = 1000


def keyword_sets(top: DataFrame, doc: str, term: str = "term", most: int = 25, min_docs: int = 5, least: int = 2) -> DataFrame:
    """(terms, docs): the `most` frequent sets of `least` terms or more that are top terms of the same documents, in
    min_docs of them at least, equally frequent ones by their terms. A set is in no more documents than any of its parts
    of `least` terms, and these are sets themselves, so what the `most`-th most frequent of these reaches is a bound for
    all: first from the parts made of FIRST_TERMS frequent terms, then from those of all terms that reach this bound. Sets
    of terms in parts that reach the last bound are found by frequent-pattern trees, without listing the subsets of every
    document; a set's terms are sorted."""
    from pyspark.ml.fpm import FPGrowth

    checkpoint_dir(top.sparkSession)
    baskets = top.where(F.col(term).isNotNull()).groupBy(doc).agg(F.collect_set(term).alias("items")).where(F.size("items") >= least).select(F.monotonically_increasing_id().alias("b"), "items").checkpoint()
    each = baskets.select("b", F.explode("items").alias("item"))
    freqs = each.groupBy("item").agg(F.count("*").alias("n")).where(F.col("n") >= min_docs).checkpoint()

    def among(items: DataFrame) -> DataFrame:
        """(parts, n): the parts of `least` terms of the baskets' share in items, in min_docs baskets or more."""
        own = each.join(items.select("item"), "item", "left_semi").groupBy("b").agg(F.array_sort(F.collect_list("item")).alias("items"))
        parts = F.transform("items", lambda x, i: F.struct(F.array(x).alias("set"), i.alias("i")))
        for _ in range(least - 1):
            parts = F.flatten(F.transform(parts, lambda p: F.transform(F.slice("items", p["i"] + 2, F.size("items")), lambda x, j: F.struct(F.concat(p["set"], F.array(x)).alias("set"), (p["i"] + 1 + j).alias("i")))))
        return own.where(F.size("items") >= least).select(F.explode(parts).alias("p")).groupBy(F.col("p.set").alias("parts")).agg(F.count("*").alias("n")).where(F.col("n") >= min_docs)

    def bound(parts: DataFrame) -> int:
        best = parts.orderBy(F.desc("n")).limit(most).select("n").collect()  # `most` rows
        return min(r["n"] for r in best) if len(best) == most else min_docs

    lowest = bound(among(freqs.orderBy(F.desc("n"), "item").limit(FIRST_TERMS)))
    parts = among(freqs.where(F.col("n") >= lowest)).checkpoint()
    lowest = bound(parts)
    items = parts.where(F.col("n") >= lowest).select(F.explode("parts").alias("item")).distinct()
    kept = each.join(items, "item", "left_semi").groupBy("b").agg(F.collect_list("item").alias("items")).where(F.size("items") >= least).checkpoint()
    n = kept.count()
    if not n:
        return kept.select(F.lit("").alias("terms"), F.lit(0).cast("long").alias("docs")).where(F.lit(False))
    found = FPGrowth(itemsCol="items", minSupport=(lowest - 0.5) / n).fit(kept).freqItemsets
    sets = found.where((F.size("items") >= least) & (F.col("freq") >= lowest)).select(F.array_join(F.array_sort("items"), " ").alias("terms"), F.col("freq").alias("docs"))
    return sets.orderBy(F.desc("docs"), "terms").limit(most)


def in_frequency_range(freqs: DataFrame, low: float, high: float, n_docs: DataFrame) -> DataFrame:
    """Terms with low <= df <= high; bounds below 1 are shares of N."""
    bound = lambda x: F.lit(x) * F.col("n") if x < 1 else F.lit(x)
    return freqs.crossJoin(F.broadcast(n_docs)).where((F.col("df") >= bound(low)) & (F.col("df") <= bound(high))).drop("n")  # one row
