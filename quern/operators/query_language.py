"""A query language for text indexes: brackets, required and excluded clauses, phrases, nearness, boosts, prefixes and
near spellings, read into a tree that is put together from joins on the index's postings.

    query   := clause { ["AND" | "OR"] clause }
    clause  := ["+" | "-" | "NOT"] [field ":"] item ["^" number]
    item    := "(" query ")" | '"' words '"' ["~" number] | word | word "*" | word "~" [number]

Clauses without a sign are alternatives (with `conjunctive`, required); AND requires both neighbours. A group with a
required clause needs all of these, any other group one of its clauses; excluded clauses leave documents out.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.text_index import SHINGLES, TextIndex

MAY, MUST, NOT = "may", "must", "not"
TOKEN = re.compile(r'\s*(?:(?P<phrase>"[^"]*")|(?P<sign>[+\-!](?=\S))|(?P<mark>[()^~*])|(?P<field>\w+):(?=\S)|(?P<both>&&)|(?P<either>\|\|)|(?P<word>[^\s()"^~*]+))')


@dataclass(frozen=True)
class Node:
    """A leaf (word, prefix, phrase or near spelling of a field) or a group of (occurrence, node)."""

    kind: str
    field: str = ""
    words: tuple[str, ...] = ()
    near: int = 0
    boost: float = 1.0
    clauses: tuple[tuple[str, Node], ...] = ()


class _Parser:
    def __init__(self, line: str, conjunctive: bool):
        self.tokens, self.at, self.plain = [], 0, MUST if conjunctive else MAY
        end = len(line.rstrip())
        at = 0
        while at < end:
            m = TOKEN.match(line, at)
            if m is None:
                raise ValueError(f"cannot read the query from {line[at:]!r}")
            kind = m.lastgroup
            value = m[kind]
            kind = {"AND": "both", "OR": "either", "NOT": "sign"}.get(value, kind) if kind == "word" else kind
            self.tokens.append((kind, value))
            at = m.end()

    def next_is(self, kind: str, value: str | None = None) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] == kind and (value is None or self.tokens[self.at][1] == value)

    def take(self, kind: str, value: str | None = None) -> str | None:
        if not self.next_is(kind, value):
            return None
        self.at += 1
        return self.tokens[self.at - 1][1]

    def number(self, default: float) -> float:
        if self.next_is("word") and re.fullmatch(r"\d+(\.\d+)?", self.tokens[self.at][1]):
            return float(self.take("word"))
        return default

    def query(self, field: str) -> Node:
        clauses: list[tuple[str, Node]] = []
        both = False
        while self.at < len(self.tokens) and not self.next_is("mark", ")"):
            if self.take("both"):
                both = True
                if clauses and clauses[-1][0] != NOT:
                    clauses[-1] = MUST, clauses[-1][1]
                continue
            if self.take("either"):
                both = False
                continue
            sign = self.take("sign")
            node = self.clause(field)
            if node is not None:
                clauses.append((NOT if sign in ("-", "!", "NOT") else MUST if sign == "+" or both else self.plain, node))
            both = False
        return Node("group", clauses=tuple(clauses))

    def clause(self, field: str) -> Node | None:
        field = self.take("field") or field
        if self.take("mark", "("):
            node = self.query(field)
            if not self.take("mark", ")"):
                raise ValueError("a bracket isn't closed")
        elif (phrase := self.take("phrase")) is not None:
            words = tuple(re.findall(r"\w+", phrase.lower()))
            node = Node("phrase" if len(words) > 1 else "word", field, words) if words else None
            if self.take("mark", "~") and node is not None:
                node = replace(node, near=int(self.number(0)))
        elif (word := self.take("word")) is not None:
            words = tuple(re.findall(r"\w+", word.lower()))
            node = Node("phrase" if len(words) > 1 else "word", field, words) if words else None
            if self.take("mark", "*"):
                node = node and replace(node, kind="prefix") if len(words) == 1 else node
            elif self.take("mark", "~"):
                node = node and replace(node, kind="fuzzy", near=int(self.number(2))) if len(words) == 1 else node
        else:
            raise ValueError(f"unexpected {self.tokens[self.at][1]!r}" if self.at < len(self.tokens) else "the query ends too early")
        if self.take("mark", "^"):
            boost = self.number(1.0)
            node = node and replace(node, boost=node.boost * boost)
        return node


def parse(line: str, field: str = "text", conjunctive: bool = False) -> Node:
    """The tree of a query line; a line that doesn't follow the grammar raises ValueError."""
    parser = _Parser(line, conjunctive)
    node = parser.query(field)
    if parser.at < len(parser.tokens):
        raise ValueError("a bracket is closed that isn't open")
    return node


def _leaf(index: TextIndex, node: Node) -> DataFrame:
    """(doc, tf) of a leaf's occurrences; the blocks of its terms are read only."""
    own = F.col("field") == node.field
    if node.kind == "word":
        return index.postings(own & (F.col("term") == node.words[0])).select("doc", "tf")
    if node.kind == "prefix":
        found = index.postings(own & F.startswith("term", F.lit(node.words[0])))
    elif node.kind == "fuzzy":
        word, most = node.words[0], node.near
        found = index.postings(own & F.length("term").between(len(word) - most, len(word) + most) & (F.levenshtein("term", F.lit(word), most) >= 0))
    else:
        return _phrase(index, node)
    return found.groupBy("doc").agg(F.sum("tf").alias("tf"))


def _phrase(index: TextIndex, node: Node) -> DataFrame:
    """(doc, tf): phrases, by shingles where the index has them; near ones by windows of shifted places.

    A word's place less its number in the phrase is the same for all words of an occurrence. With nearness n, tf counts
    the places at which a window of n + 1 such numbers begins that has one of every word.
    """
    n = len(node.words)
    if not node.near:
        joined = " ".join(node.words)
        shingled = index.terms().where((F.col("field") == SHINGLES.format(node.field)) & (F.size(F.split("term", " ")) == n)).limit(1).count()
        if shingled:
            return index.postings((F.col("field") == SHINGLES.format(node.field)) & (F.col("term") == joined)).select("doc", "tf")
    at = F.array(*[F.struct(F.lit(w).alias("w"), F.lit(i).alias("i")) for i, w in enumerate(node.words)])
    rows = index.postings((F.col("field") == node.field) & F.col("term").isin(*set(node.words))).select("doc", "positions", F.explode(F.filter(at, lambda x: x["w"] == F.col("term"))).alias("x"))
    shifted = rows.select("doc", "x.i", F.transform("positions", lambda p: p - F.col("x.i")).alias("p"))
    if not node.near:
        starts = shifted.select("doc", F.explode("p").alias("p")).groupBy("doc", "p").agg(F.count("*").alias("n")).where(F.col("n") == n)
        return starts.groupBy("doc").agg(F.count("*").alias("tf"))
    every = shifted.groupBy("doc").agg(F.collect_list("p").alias("ps")).where(F.size("ps") == n)
    inside = lambda v: F.forall("ps", lambda p: F.exists(p, lambda q: (q >= v) & (q <= v + node.near)))
    counted = every.select("doc", F.size(F.filter(F.array_distinct(F.flatten("ps")), inside)).cast("long").alias("tf"))
    return counted.where("tf > 0")


def run(index: TextIndex, node: Node, n_docs: int | None = None) -> DataFrame:
    """(doc, score): the documents that a tree finds. A leaf scores its occurrences times ln(N / documents that have it)
    and its boost; a group adds up what its clauses score, times its boost; excluded clauses score nothing."""
    n_docs = index.n_docs() if n_docs is None else n_docs
    if node.kind != "group":
        hits = _leaf(index, node)
        df = hits.agg(F.count("*").alias("df"))
        return hits.crossJoin(F.broadcast(df)).select("doc", (F.col("tf") * F.log(F.lit(n_docs) / F.col("df")) * node.boost).alias("score"))  # one row
    wanted = [(kind, run(index, c, n_docs)) for kind, c in node.clauses if kind != NOT]
    if not wanted:
        return index.docs().select("doc", F.lit(0.0).alias("score")).where(F.lit(False))
    need = sum(kind == MUST for kind, _ in wanted)
    rows = reduce(DataFrame.unionByName, [hits.withColumn("must", F.lit(kind == MUST)) for kind, hits in wanted])
    found = rows.groupBy("doc").agg((F.sum("score") * node.boost).alias("score"), F.count_if("must").alias("n")).where(F.col("n") == need if need else F.lit(True)).drop("n")
    for kind, c in node.clauses:
        if kind == NOT:
            found = found.join(run(index, c, n_docs).select("doc"), "doc", "left_anti")
    return found


def search(index: TextIndex, line: str, field: str = "text", k: int | None = None, conjunctive: bool = False) -> DataFrame:
    """(doc, score) of all hits of a query line, or with k (doc, score, rank) of the best, ties by document. A line of
    plain words reads the blocks only that can hold one of the best."""
    tree, index = parse(line, field, conjunctive), index.snapshot()
    if k is not None and tree.clauses and all(kind == MAY and c == Node("word", field, c.words) for kind, c in tree.clauses) and len({c.words for _, c in tree.clauses}) == len(tree.clauses):
        return index.top([c.words[0] for _, c in tree.clauses], field, k)
    hits = run(index, tree).withColumn("score", F.round("score", 6))
    if k is None:
        return hits
    best = hits.orderBy(F.desc("score"), "doc").limit(k)  # k rows
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "doc")))
