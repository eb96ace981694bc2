"""A hidden Markov model of tags: counted in Spark, decoded by Viterbi over the sentences of Arrow batches."""

from __future__ import annotations

import sys
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Letters of the endings by which words are told that the training rows don't have.
ENDING = 2


@dataclass
class TagModel:
    """tags; starts[tag] and moves[tag, next] as logarithms; words and endings: (word, e), the logarithm of each tag's
    share of giving that word, in the order of tags; other: the same for what has no known ending either."""

    tags: list[str]
    starts: np.ndarray
    moves: np.ndarray
    words: DataFrame
    endings: DataFrame
    other: list[float]


def _ending(word: Column) -> Column:
    return F.right(F.lower(word), F.lit(ENDING))


def train(tagged: DataFrame, sentence: str, pos: str, word: str = "word", tag: str = "tag", smooth: float = 0.1) -> TagModel:
    """Counts moves between the tags of a sentence and the words of each tag, each with `smooth` added. What comes to the
    driver is a number a pair of tags; words stay a table. Rows without a word or tag are left out; rows of equal place
    are taken in the order of word and tag."""
    rows = tagged.where(F.col(word).isNotNull() & F.col(tag).isNotNull()).select(sentence, pos, F.lower(word).alias("word"), F.col(tag).alias("tag"))
    w = Window.partitionBy(sentence).orderBy(pos, "word", "tag")
    counted = rows.select(F.lag("tag").over(w).alias("before"), "tag").groupBy("before", "tag").agg(F.count("*").alias("n")).collect()  # a row a pair of tags
    tags = sorted({r["tag"] for r in counted})
    at = {t: i for i, t in enumerate(tags)}
    starts, moves, sizes = np.full(len(tags), smooth), np.full((len(tags), len(tags)), smooth), np.zeros(len(tags))
    for r in counted:
        sizes[at[r["tag"]]] += r["n"]
        if r["before"] is None:
            starts[at[r["tag"]]] += r["n"]
        else:
            moves[at[r["before"]], at[r["tag"]]] += r["n"]
    kinds = rows.agg(F.count_distinct("word").alias("n")).first()["n"]
    below = [float(n + smooth * (kinds + 1)) for n in sizes]

    def given(key: Column) -> DataFrame:
        each = rows.groupBy(key.alias("word"), "tag").agg(F.count("*").alias("n")).groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("tag", "n"))).alias("c"))
        logs = [F.log((F.coalesce(F.element_at("c", F.lit(t)), F.lit(0)) + smooth) / below[at[t]]) for t in tags]
        return each.select("word", F.array(*logs).alias("e"))

    total = max(sizes.sum(), 1.0)
    return TagModel(tags, np.log(starts / starts.sum()) if tags else starts, np.log(moves / moves.sum(axis=1, keepdims=True)) if tags else moves, given(F.col("word")), given(_ending(F.col("word"))), [float(np.log((n + smooth) / (total + smooth))) for n in sizes])


def viterbi(emissions: np.ndarray, starts: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The likeliest tags of one sentence, (words, tags) of logarithms; of equals the first tag."""
    score, back = starts + emissions[0], []
    for e in emissions[1:]:
        through = score[:, None] + moves
        back.append(through.argmax(axis=0))
        score = through.max(axis=0) + e
    path = [int(score.argmax())]
    for b in reversed(back):
        path.append(int(b[path[-1]]))
    return np.asarray(path[::-1])


def tag_words(tokens: DataFrame, model: TagModel, sentence: str, pos: str, word: str = "word") -> DataFrame:
    """(sentence, pos, word, tag): the likeliest tags of each sentence as a whole. Words meet their emissions in a join,
    unknown ones by their last letters; a sentence is decoded in one place and so has to fit there. Null words are unknown
    words; without any tag in training there is none here."""
    rows = tokens.select(sentence, pos, word, F.lower(F.coalesce(F.col(word), F.lit(""))).alias("__w"))
    found = rows.join(model.words.select(F.col("word").alias("__w"), F.col("e").alias("__e")), "__w", "left")
    found = found.withColumn("__x", _ending(F.col("__w"))).join(model.endings.select(F.col("word").alias("__x"), F.col("e").alias("__f")), "__x", "left")
    other = F.array(*[F.lit(x) for x in model.other]) if model.other else F.array().cast("array<double>")
    each = found.select(sentence, pos, word, F.coalesce("__e", "__f", other).alias("e"))
    packed = each.groupBy(sentence).agg(F.sort_array(F.collect_list(F.struct(pos, word, "e"))).alias("__s")).select(sentence, F.transform("__s", lambda x: x[pos]).alias("pos"), F.transform("__s", lambda x: x[word]).alias("word"), F.flatten(F.transform("__s", lambda x: x["e"])).alias("e"))
    schema = StructType([rows.schema[sentence], StructField("pos", packed.schema["pos"].dataType), StructField("word", packed.schema["word"].dataType), *StructType.fromDDL("tags array<string>")])

    tags, starts, moves = model.tags, model.starts, model.moves  # the model's tables stay behind

    def decode(batches):
        for batch in batches:
            out = []
            for n, e in zip(batch.column("pos").value_lengths().to_pylist(), batch.column("e"), strict=True):
                if not tags:
                    out.append([None] * n)
                    continue
                path = viterbi(np.asarray(e.values).reshape(n, -1), starts, moves)
                out.append([tags[i] for i in path])
            yield pa.RecordBatch.from_arrays([batch.column(sentence), batch.column("pos"), batch.column("word"), pa.array(out, pa.list_(pa.string()))], names=[sentence, "pos", "word", "tags"])

    tagged = packed.mapInArrow(decode, schema).select(sentence, F.explode(F.arrays_zip("pos", "word", "tags")).alias("x"))
    return tagged.select(sentence, F.col("x.pos").alias(pos), F.col("x.word").alias(word), F.col("x.tags").alias("tag"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
