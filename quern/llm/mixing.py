"""Mixing sources to target weights: a budget of tokens flows down a domain-language-source tree by weight. What a node
can't supply goes to its siblings first and only then back up to its ancestors' siblings. Each leaf then takes the
prefix of a seeded order of its documents, over as many epochs as allowed."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm._common import fresh, Scratch

#: Leaves of the tree up to which budgets are worked out on the driver; larger trees are worked out by DataFrames.
DRIVER_LEAVES = 20_000
OUTPUT = ("mix_domain", "mix_tokens", "mix_epoch")


@dataclass(frozen=True)
class Mix:
    """Weights by path prefix: (domain,), (domain, lang), (domain, lang, source); a path that isn't named has weight 1.
    domains maps a domain to its sources; other sources belong to `other`."""

    domains: tuple[tuple[str, tuple[str, ...]], ...] = (
        ("forum", ("src0",)),
        ("web", ("src1", "src2", "src3", "src4", "src5", "src6", "src7")),
        ("books", ("src8", "src9", "src10", "src11")),
    )
    weights: dict[tuple[str, ...], float] = field(default_factory=lambda: {("forum",): 1.0, ("web",): 3.0, ("books",): 2.0, ("books", "en"): 2.0})
    fraction: float = 0.5
    max_epochs: int = 2
    seed: int = 17

    def domain(self, source: Column) -> Column:
        out = F.lit("other")
        for name, sources in self.domains:
            out = F.when(source.isin(*sources), F.lit(name)).otherwise(out)
        return out


def allocate(supply: dict[tuple[str, ...], int], weights: dict[tuple[str, ...], float], budget: int) -> dict[tuple[str, ...], int]:
    """Tokens for each leaf. supply: what a leaf can give at most.

    At every node the budget is split among the children by weight; a child that can't take its part keeps what it has
    and the rest is split among its siblings anew. What a node can supply counts only leaves that positive weights lead
    to, and no node gets more than that, so a shortage that siblings can't cover has already been moved to the
    ancestors' siblings. Rounding goes by largest remainder, ties to the smaller path, so the result depends on nothing
    but the arguments.
    """
    sums: dict[tuple[str, ...], int] = {}
    children: dict[tuple[str, ...], set[tuple[str, ...]]] = {}
    for path, n in supply.items():
        for k in range(len(path), -1, -1):
            sums[path[:k]] = sums.get(path[:k], 0) + n
            if k:
                children.setdefault(path[: k - 1], set()).add(path[:k])
                if weights.get(path[:k], 1.0) <= 0:
                    n = 0
    out: dict[tuple[str, ...], int] = {}

    def split(prefix: tuple[str, ...], budget: int) -> None:
        if prefix not in children:
            out[prefix] = budget
            return
        given = {c: 0 for c in children[prefix]}
        open_ = sorted(c for c in given if weights.get(c, 1.0) > 0)
        left = budget
        while open_:
            scale = sum(weights.get(c, 1.0) for c in open_)
            full = [c for c in open_ if left * weights.get(c, 1.0) / scale >= sums[c]]
            if full:
                for c in full:
                    given[c] = sums[c]
                left -= sum(sums[c] for c in full)
                open_ = [c for c in open_ if c not in set(full)]
                continue
            exact = {c: left * weights.get(c, 1.0) / scale for c in open_}
            given |= {c: int(x) for c, x in exact.items()}
            spare = left - sum(given[c] for c in open_)
            for c in sorted(open_, key=lambda c: (int(exact[c]) - exact[c], c))[:spare]:
                given[c] += 1
            break
        for c, n in given.items():
            split(c, n)

    if supply:
        split((), min(budget, sums[()]))
    return out


def _weight(path: list[str], weights: dict[tuple[str, ...], float]) -> Column:
    """The weight of the node that the columns lead to."""
    own = {k: v for k, v in weights.items() if len(k) == len(path)}
    out = F.lit(1.0)
    for k, v in own.items():
        match = F.lit(True)
        for c, x in zip(path, k, strict=True):
            match = match & (F.col(c) == x)
        out = F.when(match, F.lit(float(v))).otherwise(out)
    return out


def _split_level(scratch: Scratch, name: str, nodes: DataFrame, parent: list[str], child: str) -> DataFrame:
    """nodes(parent columns, child, w, can, budget of the parent) -> (parent, child, given): the split of allocate() at
    all parents at once. Each round closes the children that can't take their part; a round is one aggregation."""
    state = nodes.select(*parent, child, "w", "can", "budget", F.when(F.col("w") <= 0, F.lit(0).cast("long")).alias("given"))
    k = 0
    while True:
        open_ = F.col("given").isNull()
        keys = [F.col(c) for c in parent] or [F.lit(0)]
        sums = state.groupBy(*[x.alias(f"k{i}") for i, x in enumerate(keys)]).agg(F.sum(F.when(open_, F.col("w"))).alias("scale"), F.sum(F.coalesce("given", F.lit(0))).alias("taken"))
        joined = state.join(sums, [F.col(f"k{i}") == x for i, x in enumerate(keys)]).withColumn("left", F.col("budget") - F.col("taken"))
        exact = F.col("left") * F.col("w") / F.col("scale")
        full = open_ & (exact >= F.col("can"))
        step = joined.select(*parent, child, "w", "can", "budget", F.when(full, F.col("can")).otherwise(F.col("given")).alias("given"), full.alias("closed"), F.when(open_, exact).alias("exact"), "left")
        step = scratch.table(step, f"{name}_{k}")
        if k:
            scratch.drop(f"{name}_{k - 1}")
        if step.where("closed").isEmpty():
            break
        state, k = step.drop("closed", "exact", "left"), k + 1
    # Largest remainders: whole ranges of them get a token each, only one range a parent has to be ranked.
    part = step.withColumn("whole", F.floor("exact").cast("long")).withColumn("rest", F.col("exact") - F.floor("exact"))
    part = part.withColumn("range", F.floor((1 - F.col("rest")) * 65536).cast("int"))
    per = part.where("given IS NULL").groupBy(*parent, "range").agg(F.count("*").alias("n"), F.sum("whole").alias("whole_sum"), F.first("left").alias("left"))
    running = Window.partitionBy(*parent).orderBy("range")  # at most 65,537 ranges a parent
    spare = F.first("left").over(Window.partitionBy(*parent)) - F.sum("whole_sum").over(Window.partitionBy(*parent))
    ranges = per.withColumn("before", F.sum("n").over(running) - F.col("n")).withColumn("spare", spare).select(*parent, "range", "n", "before", "spare")
    placed = part.join(ranges, [*parent, "range"], "left")
    within = Window.partitionBy(*parent, "range").orderBy(F.desc("rest"), child)
    cut_ = (F.col("before") < F.col("spare")) & (F.col("before") + F.col("n") > F.col("spare"))
    ranked = placed.where("given IS NULL").where(cut_).withColumn("r", F.col("before") + F.row_number().over(within))
    extra = F.when(F.col("r") <= F.col("spare"), 1).otherwise(0)
    easy = placed.where(F.col("given").isNotNull() | ~F.coalesce(cut_, F.lit(False)))
    one = F.when(F.col("before") + F.col("n") <= F.col("spare"), 1).otherwise(0)
    out = easy.select(*parent, child, F.coalesce("given", F.col("whole") + one).alias("given")).unionAll(ranked.select(*parent, child, (F.col("whole") + extra).alias("given")))
    return scratch.table(out, f"{name}_given")


def allocate_wide(leaves: DataFrame, weights: dict[tuple[str, ...], float], budget: int, path: tuple[str, ...]) -> DataFrame:
    """allocate() for leaves(path columns, can) of any number: (path columns, given)."""
    scratch = Scratch(leaves.sparkSession)
    levels = []
    down = leaves.select(*path, "can")
    for k in range(len(path), 0, -1):
        own = list(path[:k])
        level = down.groupBy(*own).agg(F.sum("can").alias("can")).withColumn("w", _weight(own, weights))
        level = scratch.table(level, f"level{k}")
        levels.append(level)
        down = level.select(*own, F.when(F.col("w") > 0, F.col("can")).otherwise(0).alias("can"))
    most = down.agg(F.coalesce(F.sum("can"), F.lit(0))).first()[0]
    given = None
    for k, level in enumerate(reversed(levels), start=1):
        parent, child = list(path[: k - 1]), path[k - 1]
        nodes = level.withColumn("budget", F.lit(min(budget, most)).cast("long")) if given is None else level.join(given.withColumnRenamed("given", "budget"), parent)
        given = _split_level(scratch, f"split{k}", nodes, parent, child)
    return given


def mix_sources(docs: DataFrame, mix: Mix | None = None, driver_leaves: int = DRIVER_LEAVES) -> DataFrame:
    """docs with all columns, one row per chosen document and epoch, plus mix_domain, mix_tokens and mix_epoch; columns
    that have these names already are replaced.

    Tokens are runs of anything but ASCII white space. The budget is `fraction` of all tokens. A leaf's documents are
    ordered by a seeded hash of id and text in each epoch; the prefix that begins before the leaf's budget is used up is
    taken, so a leaf with a budget is never empty. Null source or lang form leaves of their own; documents without
    tokens, null and empty texts among them, are never chosen; repeated rows count separately; null ids are ids like
    others; rows equal in id and text come in the order of all their columns as JSON. An empty table stays empty.

    A leaf may hold any share of the rows: running totals are taken inside hash ranges of a leaf, then over ranges.
    """
    mix = mix or Mix()
    docs = docs.drop(*OUTPUT)
    names = docs.columns
    domain, lang, source, count, epoch, budget, hash_, range_, sum_, before, cut_, at = fresh(docs, 12)
    tokens = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    rows = docs.select(
        "*",
        tokens.alias(count),
        mix.domain(F.coalesce("source", F.lit(""))).alias(domain),
        F.coalesce("lang", F.lit("")).alias(lang),
        F.coalesce("source", F.lit("")).alias(source),
    ).where(F.col(count) > 0)
    leaf = [domain, lang, source]
    scratch = Scratch(docs.sparkSession)
    leaves = scratch.table(rows.groupBy(*leaf).agg(F.sum(count).alias("n"), F.count("*").alias("docs")), "leaves")
    total, most_docs, n_leaves = leaves.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("docs"), F.lit(0)), F.count("*")).first()
    if n_leaves <= driver_leaves:
        supply = {(r[0], r[1], r[2]): r["n"] for r in leaves.toLocalIterator()}
        given = allocate({k: n * mix.max_epochs for k, n in supply.items()}, mix.weights, int(mix.fraction * total))
        budgets = docs.sparkSession.createDataFrame([(*k, n) for k, n in sorted(given.items())], f"{domain} string, {lang} string, {source} string, given long")
    else:
        budgets = allocate_wide(leaves.withColumn("can", F.col("n") * mix.max_epochs), mix.weights, int(mix.fraction * total), tuple(leaf))
    epochs = F.explode(F.sequence(F.lit(0), F.lit(mix.max_epochs - 1)))
    quotas = budgets.join(leaves, leaf).select(*leaf, epochs.alias(epoch), "given", "n").select(*leaf, epoch, (F.col("given") - F.col(epoch) * F.col("n")).alias(budget)).where(F.col(budget) > 0)
    small = n_leaves <= driver_leaves
    quotas = F.broadcast(quotas) if small else quotas  # the bound on leaves times the epochs
    wanted = rows.join(quotas, leaf).withColumn(hash_, F.xxhash64(F.lit(mix.seed), epoch, "doc_id", "text"))
    bits = min(24, max(4, (most_docs // 4096).bit_length()))
    wanted = wanted.withColumn(range_, F.shiftright(hash_, 64 - bits))  # in the order of the hash
    group = [*leaf, epoch]
    sums = wanted.groupBy(*group, budget, range_).agg(F.sum(count).alias(sum_))
    running = Window.partitionBy(*group).orderBy(range_).rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    starts = sums.withColumn(before, F.coalesce(F.sum(sum_).over(running), F.lit(0)))
    cuts = starts.where(F.col(before) < F.col(budget)).groupBy(*group).agg(F.max(range_).alias(cut_), F.max(before).alias(before))
    cuts = F.broadcast(cuts) if small else cuts  # a row per leaf and epoch
    near = wanted.join(cuts, group).where(F.col(range_) <= F.col(cut_))
    whole = near.where(F.col(range_) < F.col(cut_))
    tie = F.to_json(F.struct(*[F.col(f"`{c}`") for c in names if c != "text"]))
    within = Window.partitionBy(*group).orderBy(hash_, "doc_id", "text", tie).rowsBetween(Window.unboundedPreceding, -1)  # one range
    last = near.where(F.col(range_) == F.col(cut_)).withColumn(at, F.col(before) + F.coalesce(F.sum(count).over(within), F.lit(0)))
    columns = [*[F.col(f"`{c}`") for c in names], F.col(domain).alias("mix_domain"), F.col(count).alias("mix_tokens"), F.col(epoch).alias("mix_epoch")]
    return whole.select(*columns).unionByName(last.where(F.col(at) < F.col(budget)).select(*columns))


def mix_report(docs: DataFrame, mix: Mix | None = None) -> DataFrame:
    """doc_id, domain, lang, source, epoch and n_tokens of the chosen documents."""
    out = mix_sources(docs.select("doc_id", "text", "lang", "source"), mix)
    return out.select("doc_id", F.col("mix_domain").alias("domain"), "lang", "source", F.col("mix_epoch").alias("epoch"), F.col("mix_tokens").alias("n_tokens"))
