"""Line dedup with a tree of log templates: a line's path through the tree is its token count and its leading tokens
with variable fields generalised; the fixed depth generalises what follows. Templates that recur across documents are
dropped. Built from DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm._common import BLANKS, fresh, Scratch

DEPTH = 8
#: A token with a digit is a variable field.
VARIABLE = r"[^ ]*[0-9][^ ]*"
#: Mark put in the place of a variable field.
FIELD = "<*>"
#: Shorter lines are leaves of their own.
SHORT = 4
#: Id of lines without a template.
NONE = 0
#: Tokens of a chunk, the unit by which texts are compared. Chunks begin with a line, and at every token for which first
#: code point plus three times length is a multiple of ANCHOR, so that an edit changes the chunks around it only.
CHUNK, ANCHOR = 8, 8
#: Documents of whose chunks less than one in MIN_OWN is their own may be near copies: 14 in 16 chunks in common, the
#: others different, make a similarity of 0.78.
MIN_OWN = 8
KEY = ["t1", "t2", "t3"]


def template_path(tokens: Column, depth: int = DEPTH, min_tokens: int = SHORT) -> Column:
    """The leaf a line of these tokens belongs to, as text: token count, then the leading tokens; lines of fewer than
    SHORT tokens are leaves as they stand, variable fields included. Null for fewer than min_tokens tokens or none."""
    lead = F.regexp_replace(F.array_join(F.slice(tokens, 1, depth), " "), VARIABLE, FIELD)
    if min_tokens < SHORT:
        lead = F.when(F.size(tokens) < SHORT, F.array_join(tokens, " ")).otherwise(lead)
    return F.when(F.size(tokens) >= max(min_tokens, 1), F.concat(F.size(tokens).cast("string"), F.lit(" "), lead))


def _parsed(text: Column, depth: int, min_tokens: int) -> Column:
    """For every line its template's id (NONE without one) and its chunks' hashes."""

    def line(t: Column) -> Column:
        path = template_path(t, depth, min_tokens)
        begins = F.filter(F.sequence(F.lit(1), F.size(t)), lambda i: (i == 1) | ((F.ascii(F.element_at(t, i)) + 3 * F.length(F.element_at(t, i))) % ANCHOR == 0))
        chunks = F.transform(begins, lambda i: F.xxhash64(F.slice(t, i, CHUNK)))
        return F.struct(
            F.when(path.isNull(), F.lit(NONE)).otherwise(F.xxhash64(path)).cast("long").alias("id"),
            F.when(F.size(t) > 0, chunks).otherwise(F.array().cast("array<long>")).alias("chunks"),
        )

    tokens = lambda x: F.array_remove(F.split(x, BLANKS), "")
    return F.transform(F.split(text, "\n"), lambda x: F.element_at(F.transform(F.array(tokens(x)), line), 1))


def _keys(text: Column) -> list[Column]:
    """A text's key: two hashes and its length."""
    return [c.alias(k) for c, k in zip((F.xxhash64(text), F.hash(text), F.length(text)), KEY, strict=True)]


def _distinct_texts(docs: DataFrame, depth: int, min_tokens: int) -> DataFrame:
    """One row a distinct text: its key, ids (a template a line) and its distinct chunks."""
    text = F.coalesce(F.col("text"), F.lit(""))
    parsed = docs.select(*_keys(text), _parsed(text, depth, min_tokens).alias("p"))
    return parsed.select(*KEY, F.col("p.id").alias("ids"), F.array_distinct(F.flatten("p.chunks")).alias("chunks")).dropDuplicates(KEY)


def _recurring(sets: DataFrame, min_docs: int, scratch: Scratch) -> DataFrame:
    """(template): the templates found in min_docs unlike documents or more, however many copies of others hold them.

    Documents of the same templates are one context. So are near copies of one another, since they are the concern of
    document-level dedup: texts with hardly a chunk of their own (MIN_OWN) that agree in their signature, the least of
    the chunks they share with min_docs texts or more. A signature stands for another if most texts that hold its chunk
    have that other one, so that copies in which the least chunk is edited are still of their group, while texts put
    together from different recurring lines are unlike. The same is done with the greatest chunk, and the larger number
    of groups counts: the line that holds the least chunk of all its texts is told by the other end.
    """
    chunks = sets.select(*KEY, F.explode("chunks").alias("chunk"))
    common = chunks.groupBy("chunk").agg(F.count("*").alias("texts")).where(F.col("texts") >= min_docs).select("chunk", F.lit(1).alias("many"))
    common = scratch.table(common, "common").hint("merge")  # it grows with the input
    shared = F.when(F.col("many").isNotNull(), F.col("chunk"))
    own = chunks.join(common, "chunk", "left").groupBy(*KEY).agg(F.count_if(F.col("many").isNull()).alias("own"), F.count("*").alias("all"), F.min(shared).alias("low"), F.max(shared).alias("high"))
    near = own.where(F.col("own") * MIN_OWN < F.col("all")).select(*KEY, F.explode(F.array(F.struct(F.lit(1).alias("end"), F.col("low").alias("sign")), F.struct(F.lit(2).alias("end"), F.col("high").alias("sign")))).alias("x"))
    near = scratch.table(near.select(*KEY, "x.end", "x.sign"), "near")
    signs = near.select(F.col("sign").alias("chunk")).distinct()
    held = sets.select(*KEY, F.explode("chunks").alias("chunk")).join(signs.hint("merge"), "chunk", "left_semi")
    pairs = held.join(near.hint("merge"), KEY).groupBy("end", "chunk", "sign").agg(F.count("*").alias("n"))
    most = pairs.groupBy("end", "chunk").agg(F.max_by("sign", "n").alias("to"), F.max("n").alias("n"), F.sum("n").alias("all")).where("2 * n > all")
    most = scratch.table(most.select("end", F.col("chunk").alias("sign"), "to"), "most")
    near = near.join(most.hint("merge"), ["end", "sign"], "left").select(*KEY, "end", F.coalesce("to", "sign").alias("near")).hint("merge")
    told = sets.join(near, KEY, "left").select(F.coalesce("end", F.lit(0)).alias("end"), F.coalesce("near", F.xxhash64("t")).alias("context"), F.explode("t").alias("template"))
    contexts = told.distinct().groupBy("template").agg(*[F.count_if(F.col("end") == k).alias(f"n{k}") for k in range(3)])
    return contexts.where(F.col("n0") + F.greatest("n1", "n2") >= min_docs).select("template")


def dedup_lines(docs: DataFrame, depth: int = DEPTH, min_tokens: int = SHORT, min_docs: int = 5, drop_empty: bool = False, report: bool = False) -> DataFrame:
    """docs with the lines of recurring templates cut out of text, all columns kept, whatever these are called. With
    report, n_lines and n_dropped are added (columns of these names are replaced).

    Repeated rows are treated alike and count as one; a null text stays null, an empty one empty; null ids are ids like
    others; lines under min_tokens tokens always stay; templates of equally many contexts go or stay together; an empty
    table stays empty. With drop_empty, documents that lose lines and have nothing but white space left are dropped.
    """
    scratch = Scratch(docs.sparkSession)
    sets = scratch.table(_distinct_texts(docs, depth, min_tokens), "sets").withColumn("t", F.array_sort(F.array_remove(F.array_distinct("ids"), F.lit(NONE).cast("long"))))
    bad = scratch.table(_recurring(sets.where(F.size("t") > 0), min_docs, scratch), "bad")
    lines = sets.select(*KEY, F.posexplode("ids").alias("line", "template")).where(F.col("template") != NONE)
    cuts = lines.join(bad.hint("merge"), "template", "left_semi").groupBy(*KEY).agg(F.collect_set("line").alias("cut"))
    *keys, cut, parts, stay = fresh(docs, 6)
    cuts = scratch.table(cuts, "cuts").toDF(*keys, cut).hint("merge")
    same = [own == F.col(k) for own, k in zip((F.xxhash64("text"), F.hash("text"), F.length("text")), keys, strict=True)]
    names = [c for c in docs.columns if not report or c.lower() not in ("n_lines", "n_dropped")]
    out = docs.join(cuts, same, "left").withColumn(parts, F.split(F.coalesce(F.col("text"), F.lit("")), "\n"))
    out = out.withColumn(stay, F.when(F.col(cut).isNotNull(), F.filter(parts, lambda x, i: ~F.array_contains(F.col(cut), i))))
    text = F.when(F.col(stay).isNotNull(), F.array_join(stay, "\n")).otherwise(F.col("text"))
    if drop_empty:
        out = out.where(F.col(stay).isNull() | ~F.array_join(stay, "\n").rlike(r"^\s*$"))
    counts = [F.size(parts).cast("long").alias("n_lines"), F.coalesce(F.size(parts) - F.size(stay), F.lit(0)).cast("long").alias("n_dropped")] if report else []
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in names], *counts)


def line_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_chars, kept_sha256 for every document (null text: empty)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return dedup_lines(docs.select("doc_id", "text"), min_tokens=1, report=True).select(
        "doc_id", "n_lines", "n_dropped", F.length(text).cast("long").alias("kept_chars"), F.sha2(text, 256).alias("kept_sha256")
    )
