"""Sentiment of texts by a lexicon and what stands around its words: negations, boosters, capitals and contrast."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: The factor of a negation; what capitals add; the weights of the three words before; the factors before and
#: after a contrast; what an exclamation mark adds and how many count; the constant that squashes the sum.
NEGATED, CAPITALS, NEARNESS = -0.74, 0.733, (1.0, 0.95, 0.9)
BEFORE_BUT, AFTER_BUT = 0.5, 1.5
EXCLAIMED, EXCLAMATIONS, SQUASH = 0.292, 4, 15.0
#: Decimals of what boosters and exclamation marks add: their products are decimal numbers, made doubles once. Values that
#: cancel out leave the same rest as in SQL then, on whose sign the exclamation marks depend.
DECIMALS = 12
#: Bytes of the tables of words up to which they travel to every task.
SENT_BYTES = 16 << 20


def compound(rows: DataFrame, key: str, text: Column, lexicon: DataFrame, boosters: DataFrame, negations: DataFrame, but: tuple[str, ...] = ("but",), sent: int = SENT_BYTES) -> DataFrame:
    """(key, compound, n_hits): for each text the sum of its words' values as they stand there, squashed to (-1, 1).

    lexicon(word, value), boosters(word, value) and negations(word) are tables of lower-cased words, the least value
    counting where a word has several. A word's value grows by each booster among the three words before it, the further
    the less, away from zero (or towards it for a negative booster), by CAPITALS where it is in capitals in a text that
    isn't all capitals, and is turned by every negation among these words. With a contrast word, what stands before the
    first one counts half and what follows one and a half times. Exclamation marks strengthen the sum, to which values are
    added in the order of the text, each multiplied by one factor after the other. Texts without a hit have 0; rows are told apart by key alone, which should be unique; a null key is a key. Tables of words of up to
    `sent` bytes, by a sum over them, travel to the texts, of which no word is exchanged; larger ones are joined.
    """
    words = F.array_remove(F.split(text, r"[^\p{L}\p{N}_']+"), "")
    shouted = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) > 1)
    base = rows.select(F.col(key).alias("k"), F.coalesce(words, F.array().cast("array<string>")).alias("w"), F.least(F.coalesce(F.length(F.regexp_replace(text, "[^!]", "")), F.lit(0)), F.lit(EXCLAMATIONS)).alias("marks"))
    base = base.withColumn("mixed", F.exists("w", shouted) & F.exists("w", lambda w: (F.upper(w) != w) & (F.lower(w) != F.upper(w))))
    one = lambda t, name: t.groupBy("word").agg(F.min("value").alias(name))
    turns = negations.select("word").distinct()
    tables = [one(lexicon, "value"), one(boosters, "boost"), turns]
    if sum(t.agg(F.coalesce(F.sum(F.octet_length("word") + 16), F.lit(0))).first()[0] for t in tables) <= sent:
        value, boost, turn = (t.where(F.col("word").isNotNull()).toArrow().to_pydict() for t in tables)  # at most `sent` bytes
        near = _beside(dict(zip(value["word"], value["value"], strict=True)), dict(zip(boost["word"], boost["boost"], strict=True)), set(turn["word"]), but)
        of_words = base.select("k", "marks", "mixed", "w", F.transform("w", F.lower).alias("l"), F.transform("w", shouted).alias("loud"))
        each = of_words.mapInArrow(near, StructType([base.schema["k"], *StructType.fromDDL("marks int, s double, n_hits long")]))
        summed = each.groupBy("k").agg(F.sum("s").alias("s"), F.max("marks").alias("marks"), F.sum("n_hits").alias("n_hits"))
    else:
        summed = _by_joins(base, *tables, but, shouted)
    total = F.col("s") + F.round(F.signum("s") * F.col("marks") * EXCLAIMED, DECIMALS)
    of_one = total / F.sqrt(total * total + SQUASH)
    rounded = F.signum(of_one) * F.floor(F.abs(of_one) * 1e6 + 0.5) / 1e6  # keeps the sign of zero, as SQL's does
    return summed.select(F.col("k").alias(key), rounded.alias("compound"), "n_hits")


def _beside(values: dict, boosts: dict, turns: set, but: tuple[str, ...]):
    """A function on batches (k, marks, mixed, w, l, loud) that sums each text's values: arrays of all words of a batch,
    moved by one to three places within their texts."""

    def rows(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                size = np.asarray(part.column("l").value_lengths()).astype(np.int64)
                row = np.repeat(np.arange(len(size)), size)
                pos = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                once = part.column("l").flatten().dictionary_encode()
                words, code = once.dictionary.to_pylist(), np.asarray(once.indices)
                of = lambda f, kind: np.array([f(x) for x in words], dtype=kind)[code] if len(code) else np.empty(0, kind)  # noqa: E731, B023
                value, boost = of(lambda x: values.get(x, np.nan), float), of(lambda x: boosts.get(x, np.nan), float)
                turn, contrast = of(lambda x: x in turns, bool), of(lambda x: x in but, bool)
                loud = part.column("loud").flatten().to_numpy(zero_copy_only=False).astype(bool) & np.repeat(part.column("mixed").to_numpy(zero_copy_only=False).astype(bool), size)
                sign = np.sign(value)
                strength, turned = value + sign * np.where(loud, CAPITALS, 0.0), []
                for k, weight in enumerate(NEARNESS, 1):
                    to = np.flatnonzero(pos >= k)
                    before = to - k
                    added = sign[to] * (boost[before] + np.where(loud[before], np.sign(boost[before]) * CAPITALS, 0.0)) * weight
                    strength[to] += np.where(np.isnan(added), 0.0, np.round(added, DECIMALS))
                    turned.append(to[turn[before]])
                for to in turned:
                    strength[to] *= NEGATED
                first = np.full(len(size), np.iinfo(np.int64).max)
                at = np.flatnonzero(contrast)
                np.minimum.at(first, row[at], pos[at])
                first = first[row]
                side = np.where(first == np.iinfo(np.int64).max, 1.0, np.where(pos < first, BEFORE_BUT, np.where(pos > first, AFTER_BUT, 1.0)))
                hit = np.flatnonzero(~np.isnan(value))
                s = np.bincount(row[hit], (strength * side)[hit], len(size))
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("marks"), pa.array(s), pa.array(np.bincount(row[hit], minlength=len(size)).astype(np.int64))], names=["k", "marks", "s", "n_hits"])

    return rows


def _by_joins(base: DataFrame, lexicon: DataFrame, boosters: DataFrame, negations: DataFrame, but: tuple[str, ...], shouted) -> DataFrame:
    """(k, s, marks, n_hits) by tables of any size: each word of a text is a row."""
    at = base.select("k", "marks", "mixed", F.posexplode_outer("w").alias("pos", "own")).withColumn("word", F.lower("own"))
    at = at.join(lexicon, "word", "left").join(boosters, "word", "left").join(negations.withColumn("turn", F.lit(1)), "word", "left")
    w = Window.partitionBy("k").orderBy("pos")
    loud = F.when(F.col("mixed") & shouted(F.col("own")), F.lit(CAPITALS)).otherwise(0.0)
    sign = F.signum("value")
    strength, turns = F.col("value") + sign * loud, []
    for k, near in enumerate(NEARNESS, 1):
        boost = F.lag("boost", k).over(w)
        louder = F.when(F.col("mixed") & shouted(F.lag("own", k).over(w)), F.signum(boost) * CAPITALS).otherwise(0.0)
        strength = strength + F.coalesce(F.round(sign * (boost + louder) * near, DECIMALS), F.lit(0.0))
        turns.append(F.when(F.lag("turn", k).over(w) == 1, F.lit(NEGATED)).otherwise(1.0))
    for turn in turns:
        strength = strength * turn
    first = F.min(F.when(F.col("word").isin(*but), F.col("pos"))).over(Window.partitionBy("k"))
    side = F.when(F.col("pos") < first, BEFORE_BUT).when(F.col("pos") > first, AFTER_BUT).otherwise(1.0)
    each = at.select("k", "marks", (strength * side).alias("v"))
    return each.groupBy("k").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("s"), F.max("marks").alias("marks"), F.count("v").alias("n_hits"))


#: Python functions of this module travel with the plan, so workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
