"""Tokens, sentences, stop words and word classes."""

from __future__ import annotations

import sys

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Anything but letters, digits and the underscore separates words, in any script.
NON_WORD = r"[^\p{L}\p{N}_]+"

#: Common English function words.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being
have has had having do does did doing a an the and but if or because as until while of at by for with about against
between into through during before after above below to from up down in out on off over under again further then once
here there when where why how all any both each few more most other some such no nor not only own same so than too very
s t can will just don should now
""".split()


def words(text: Column, lower: bool = True) -> Column:
    """Word tokens in order, without punctuation."""
    text = F.lower(text) if lower else text
    return F.array_remove(F.split(text, NON_WORD), "")


def tokens(text: Column) -> Column:
    """Words and punctuation runs, white space left out."""
    return F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"), F.lit(0))


def sentences(text: Column) -> Column:
    """Splits at ., ! and ? followed by white space, unless a single capital or a title of up to three letters stands
    before the dot. Marks stay with their sentence."""
    guarded = F.regexp_replace(text, r"\b([A-Z][a-z]{0,2})\.\s+", "$1.\u0001")
    cut = F.split(F.regexp_replace(guarded, r"([.!?])\s+", "$1\u0002"), "\u0002")
    return F.filter(F.transform(cut, lambda s: F.trim(F.replace(s, F.lit("\u0001"), F.lit(" ")))), lambda s: s != "")


def is_stop_word(word: Column) -> Column:
    return F.lower(word).isin(*STOP_WORDS)


def is_punctuation(token: Column) -> Column:
    return token.rlike(r"^[^\p{L}\p{N}_\s]+$")


def is_comma(token: Column) -> Column:
    return token == ","


def is_quote(token: Column) -> Column:
    return token.isin("'", '"', "``", "''")


#: Part-of-speech tag prefixes and the class each stands for.
TAG_CLASSES = (("NN", "noun"), ("VB", "verb"), ("JJ", "adjective"), ("RB", "adverb"), ("PR", "pronoun"), ("IN", "preposition"), ("DT", "determiner"), ("CC", "conjunction"), ("CD", "number"), ("MD", "auxiliary"), ("UH", "interjection"))


def tag_class(tag: Column, previous: Column | None = None) -> Column:
    """Word class of a tag. A gerund (VBG) after a determiner or adjective is a noun, a participle (VBN) after a
    determiner an adjective; unknown tags are `other`, punctuation is `punctuation`."""
    out = F.lit("other")
    for prefix, name in TAG_CLASSES:
        out = F.when(F.startswith(tag, F.lit(prefix)), F.lit(name)).otherwise(out)
    out = F.when(tag.rlike(r"^[^A-Za-z]+$"), F.lit("punctuation")).otherwise(out)
    if previous is not None:
        after = F.coalesce(previous, F.lit(""))
        out = F.when((tag == "VBG") & after.isin("DT", "JJ"), F.lit("noun")).when((tag == "VBN") & (after == "DT"), F.lit("adjective")).otherwise(out)
    return out


def pieces_for(words_: Column, most: int, pad: str = "[PAD]", first: str = "[CLS]", last: str = "[SEP]") -> Column:
    """first, words, last: cut or padded to `most` pieces."""
    body = F.concat(F.array(F.lit(first)), F.slice(words_, 1, most - 2), F.array(F.lit(last)))
    return F.slice(F.concat(body, F.array_repeat(F.lit(pad), most)), 1, most)


def character_names(chars: DataFrame, char: str) -> DataFrame:
    """chars with name, the Unicode name of a character, empty for one without. Each character is looked up once, in
    Arrow batches, and joined to its rows."""

    def rows(batches):
        from unicodedata import name

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([name(c, "") if len(c) == 1 else "" for c in b.column(0).to_pylist()], pa.string())], names=["__c", "name"])

    once = chars.where(F.col(char).isNotNull()).select(F.col(char).alias("__c")).distinct()
    named = once.mapInArrow(rows, "__c string, name string")
    return chars.join(named, F.col(char) == F.col("__c"), "left").drop("__c")


#: Python functions of this module travel with the plan, so workers need no copy of this library.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
