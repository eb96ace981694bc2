"""N-gram counts, simple language models and n-gram filters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.scalars import ngrams
from quern.operators.graph import checkpoint_dir


def ngram_counts(rows: DataFrame, words: Column, n: int) -> DataFrame:
    """(ngram, n)."""
    return rows.select(F.explode(ngrams(words, n, n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))


def bigram_score(rows: DataFrame, key: str, words: Column, lam: float = 0.4) -> DataFrame:
    """(key, n_words, n_unknown, score): log10 probability under bigrams of `<s> words </s>` backed off to unigrams
    with a fixed factor, unigrams smoothed by one. Trained on the rows themselves."""
    framed = rows.select(key, F.concat(F.array(F.lit("<s>")), words, F.array(F.lit("</s>"))).alias("w"))
    pairs = framed.select(key, F.explode(F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.struct(F.get("w", i - 1).alias("a"), F.get("w", i).alias("b")))).alias("x")).select(key, "x.a", "x.b")
    uni = pairs.groupBy("b").agg(F.count("*").alias("c1"))
    total = uni.agg(F.sum("c1").alias("total"), F.count("*").alias("kinds"))
    ctx = pairs.groupBy("a").agg(F.count("*").alias("ca"))
    bi = pairs.groupBy("a", "b").agg(F.count("*").alias("c2"))
    p = bi.join(ctx, "a").join(uni, "b").crossJoin(F.broadcast(total))  # one row
    low = (F.col("c1") + 1) / (F.col("total") + F.col("kinds") + 1)
    p = p.select("a", "b", F.log10((1 - lam) * F.col("c2") / F.col("ca") + lam * low).alias("lp"))
    return pairs.join(p, ["a", "b"]).groupBy(key).agg(F.count("*").alias("n_words"), F.lit(0).cast("long").alias("n_unknown"), F.round(F.sum("lp"), 6).alias("score"))


def _framed(rows: DataFrame, key: list[str], words: Column, order: int) -> DataFrame:
    """key, pos (from 1), g: the n-gram of `order` words that ends at each word or at the end mark."""
    pad = F.array(*[F.lit("<s>")] * (order - 1))
    w = rows.select(*key, F.concat(pad, words, F.array(F.lit("</s>"))).alias("w"))
    at = F.transform(F.sequence(F.lit(order), F.size("w")), lambda i: F.struct((i - order + 1).alias("pos"), F.slice("w", i - order + 1, order).alias("g")))
    return w.select(*key, F.explode(at).alias("x")).select(*key, "x.pos", "x.g")


def kneser_ney(rows: DataFrame, words: Column, order: int = 3) -> dict[int, DataFrame]:
    """An interpolated modified Kneser-Ney model of the texts: order -> (g, p, back), the probability of each n-gram and
    the weight that its own continuations leave to the next lower order; 0 -> (p), the share of an unknown word.

    Lower orders count in how many different n-grams one order up an n-gram stands; the three discounts of an order come
    from its counts of counts. Every order's counts and its share of the model are written once, in the folder for
    checkpoints, so that what is built on them doesn't work them out again; some sums of each order come to the driver.
    """
    spark = rows.sparkSession
    checkpoint_dir(spark)
    counts = {order: _framed(rows, [], words, order).groupBy("g").agg(F.count("*").alias("n")).checkpoint()}
    for m in range(order - 1, 0, -1):
        counts[m] = counts[m + 1].groupBy(F.slice("g", 2, m).alias("g")).agg(F.count("*").alias("n")).checkpoint()
    model: dict[int, DataFrame] = {}
    lower = None
    for m in range(1, order + 1):
        d = _discounts(counts[m].agg(*[F.count_if(F.col("n") == i) for i in (1, 2, 3, 4)]).first())
        own = counts[m].select("g", "n", F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2]).alias("d"), F.slice("g", 1, m - 1).alias("ctx"))
        if m == 1:
            t, gone, kinds = own.agg(F.sum("n"), F.sum("d"), F.count("*")).first()
            share = gone / t / (kinds + 1) if t else 1.0
            model[0] = spark.createDataFrame([(share,)], "p double")
            level = own.select("g", ((F.col("n") - F.col("d")) / F.lit(t or 1) + F.lit(share)).alias("p"))
        else:
            sums = own.groupBy("ctx").agg(F.sum("n").alias("t"), (F.sum("d") / F.sum("n")).alias("back")).checkpoint()
            model[m - 1] = lower.join(sums.select(F.col("ctx").alias("g"), "back"), "g", "full")
            below = lower.select(F.col("g").alias("tail"), F.col("p").alias("q"))
            level = own.join(sums, "ctx").withColumn("tail", F.slice("g", 2, m - 1)).join(below, "tail").select("g", ((F.col("n") - F.col("d")) / F.col("t") + F.col("back") * F.col("q")).alias("p"))
        model[m] = lower = level.checkpoint()
    return model


def _discounts(counts: tuple) -> list[float]:
    """The discounts of n-grams seen once, twice and more, from how many are seen once to four times."""
    if min(counts) <= 0:
        return [0.5, 1.0, 1.5]
    y = counts[0] / (counts[0] + 2 * counts[1])
    return [min(max(i - (i + 1) * y * counts[i] / counts[i - 1], 0.05), float(i)) for i in (1, 2, 3)]


def score_detail(rows: DataFrame, key: str, words: Column, model: dict[int, DataFrame]) -> DataFrame:
    """(key, pos, word, matched, lp): for every word and end mark the length of the longest n-gram that the model has (0
    for an unknown word) and log10 of its probability, backed off where the full n-gram isn't known."""
    order = max(model)
    at = _framed(rows, [key], words, order)
    for m in range(1, order + 1):
        level = model[m].select(F.col("g").alias("gm"), F.col("p").alias(f"p{m}")).where(F.col(f"p{m}").isNotNull())
        at = at.withColumn("gm", F.slice("g", order - m + 1, m)).join(level, "gm", "left").drop("gm")
        if m < order:
            back = model[m].select(F.col("g").alias("gm"), F.col("back").alias(f"b{m}")).where(F.col(f"b{m}").isNotNull())
            at = at.withColumn("gm", F.slice("g", order - m, m)).join(back, "gm", "left").drop("gm")
    p, matched = F.coalesce("p1", F.lit(model[0].first()["p"])), F.when(F.col("p1").isNotNull(), 1).otherwise(0)
    for m in range(2, order + 1):
        p = F.coalesce(F.col(f"p{m}"), F.coalesce(F.col(f"b{m - 1}"), F.lit(1.0)) * p)
        matched = F.when(F.col(f"p{m}").isNotNull(), m).otherwise(matched)
    return at.select(key, "pos", F.element_at("g", -1).alias("word"), matched.alias("matched"), F.log10(p).alias("lp"))


def score_sentences(rows: DataFrame, key: str, words: Column, model: dict[int, DataFrame]) -> DataFrame:
    """(key, n_words, n_unknown, score, perplexity): sums of the detail over each text, its end mark included."""
    each = score_detail(rows, key, words, model).groupBy(key)
    out = each.agg(F.count("*").alias("n_words"), F.count_if(F.col("matched") == 0).alias("n_unknown"), F.round(F.sum("lp"), 6).alias("score"))
    return out.withColumn("perplexity", F.round(F.pow(F.lit(10.0), -F.col("score") / F.col("n_words")), 6))


def unknown_words(rows: DataFrame, words: Column, model: dict[int, DataFrame]) -> DataFrame:
    """(word, n): the words that the model doesn't know."""
    known = model[1].where("p is not null").select(F.element_at("g", 1).alias("word"))
    return rows.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n")).join(known, "word", "left_anti")


def weighted_ngrams(rows: DataFrame, words: Column, weight: Column, n: int, top: int = 100) -> DataFrame:
    """(ngram, weight): n-grams by the sum of their rows' weights, the `top` heaviest."""
    each = rows.select(F.explode(ngrams(words, n, n)).alias("ngram"), weight.alias("w"))
    return each.groupBy("ngram").agg(F.round(F.sum("w"), 4).alias("weight")).orderBy(F.desc("weight"), "ngram").limit(top)


def known_runs(tokens: DataFrame, key: list[str], unigrams: DataFrame, bigrams: DataFrame) -> DataFrame:
    """(key, start, phrase): maximal runs of words whose neighbours form known bigrams, and known words outside runs.
    tokens: key, pos, word."""
    w = Window.partitionBy(*key).orderBy("pos")
    at = tokens.withColumn("bigram", F.concat_ws(" ", F.lag("word").over(w), "word")).withColumn("first", F.lag("word").over(w).isNull())
    known = bigrams.select(F.col("term").alias("bigram")).distinct().withColumn("k", F.lit(1))
    linked = at.join(known, "bigram", "left").withColumn("starts", F.when(F.col("k").isNull() | F.col("first"), 1).otherwise(0))
    runs = linked.withColumn("run", F.sum("starts").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    grouped = runs.groupBy(*key, "run").agg(F.min("pos").alias("start"), F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("phrase"))
    single = unigrams.select(F.col("term").alias("phrase")).distinct().withColumn("u", F.lit(1))
    return grouped.join(single, "phrase", "left").where("n > 1 or u = 1").select(*key, "start", "phrase")


def common_tags(tokens: DataFrame, tags: DataFrame, default: str = "NN") -> DataFrame:
    """tokens(word, ...) with tag, the most frequent one of tags(word, tag, freq); unknown words get the default."""
    best = tags.groupBy(F.lower("word").alias("__w")).agg(F.max_by("tag", F.struct("freq", "tag")).alias("tag"))
    return tokens.join(best, F.lower("word") == F.col("__w"), "left").withColumn("tag", F.coalesce("tag", F.lit(default))).drop("__w")


def train_chunker(tagged: DataFrame) -> DataFrame:
    """(tag, chunk): the most frequent chunk mark of each part of speech in tagged(tag, chunk), ties to the smaller."""
    counts = tagged.groupBy("tag", "chunk").agg(F.count("*").alias("n"))
    return counts.groupBy("tag").agg(F.min_by("chunk", F.struct(-F.col("n"), F.col("chunk"))).alias("chunk"))


def lexicon_score(rows: DataFrame, key: str, words: Column, lexicon: DataFrame) -> DataFrame:
    """(key, score): the sum of a text's word values in lexicon(word, value), squashed to (-1, 1); 0 without a hit."""
    each = rows.select(key, F.explode_outer(words).alias("word")).join(lexicon, "word", "left")
    total = F.coalesce(F.sum("value"), F.lit(0.0))
    return each.groupBy(key).agg(F.round(total / F.sqrt(total * total + 15), 6).alias("score"))
