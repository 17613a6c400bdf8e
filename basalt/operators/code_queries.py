"""Relational queries over nodes, edges and calls of a code graph: containment, order, neighbourhood, censuses.

Nodes are (node_id, path, kind, name, bstart, bend); calls are (path, caller, callee, n_args).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .closure import ancestor_closure


def entities(nodes: DataFrame, kind: str | None = None, name: str | None = None, within: str | None = None) -> DataFrame:
    """Nodes of a kind whose name is given, or matches what follows ``~``; ``within`` is a prefix of the path."""
    if kind:
        nodes = nodes.where(F.col("kind") == kind)
    if name:
        nodes = nodes.where(F.col("name").rlike(name[1:]) if name.startswith("~") else F.col("name") == name)
    return nodes.where(F.col("path").startswith(within)) if within else nodes


def _other(nodes: DataFrame) -> DataFrame:
    return nodes.select(F.col("path").alias("_p"), F.col("node_id").alias("_id"), F.col("bstart").alias("_s"), F.col("bend").alias("_e"))


def _where(nodes: DataFrame, others: DataFrame, test: Column) -> DataFrame:
    o = _other(others)
    return nodes.join(o, (F.col("path") == F.col("_p")) & (F.col("node_id") != F.col("_id")) & test, "left_semi")


def inside(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """Nodes that lie in one of the others, in the same path."""
    return _where(nodes, outer, (F.col("_s") <= F.col("bstart")) & (F.col("bend") <= F.col("_e")))


def has(nodes: DataFrame, inner: DataFrame) -> DataFrame:
    return _where(nodes, inner, (F.col("bstart") <= F.col("_s")) & (F.col("_e") <= F.col("bend")))


def precedes(nodes: DataFrame, later: DataFrame) -> DataFrame:
    """Nodes that end before one of the others starts; one number for each path is enough to know."""
    last = later.groupBy(F.col("path").alias("_p")).agg(F.max("bstart").alias("_s"))
    return nodes.join(last, (F.col("path") == F.col("_p")) & (F.col("bend") <= F.col("_s")), "left_semi")


def follows(nodes: DataFrame, earlier: DataFrame) -> DataFrame:
    first = earlier.groupBy(F.col("path").alias("_p")).agg(F.min("bend").alias("_e"))
    return nodes.join(first, (F.col("path") == F.col("_p")) & (F.col("bstart") >= F.col("_e")), "left_semi")


def combine(mode: str, nodes: DataFrame, *parts: DataFrame) -> DataFrame:
    """Nodes in all, in any or in none of the parts."""
    ids = [p.select("node_id").distinct() for p in parts]
    if mode == "all":
        return reduce(lambda a, b: a.join(b, "node_id", "left_semi"), ids, nodes)
    return nodes.join(reduce(DataFrame.union, ids), "node_id", "left_semi" if mode == "any" else "left_anti")


def nth_child(nodes: DataFrame, n: int, reverse: bool = False) -> DataFrame:
    """The n-th node of its parent, from 1, in text order or from the end."""
    order = [F.col("bstart").desc(), F.col("node_id").desc()] if reverse else [F.col("bstart"), F.col("node_id")]
    w = Window.partitionBy("path", "parent_id").orderBy(*order)
    return nodes.withColumn("_n", F.row_number().over(w)).where(F.col("_n") == n).drop("_n")


def decorated(nodes: DataFrame, decorators: DataFrame, name: str | None = None, low: int = 1, high: int | None = None) -> DataFrame:
    """Nodes with a decorator of a name, or with so many."""
    d = decorators if name is None else decorators.where(F.col("name") == name)
    counts = d.groupBy(F.col("node_id").alias("_id")).agg(F.count("*").alias("_n"))
    cond = (F.col("node_id") == F.col("_id")) & (F.col("_n") >= low)
    return nodes.join(counts, cond & (F.col("_n") <= high) if high is not None else cond, "left_semi")


def call_census(calls: DataFrame) -> DataFrame:
    """For each callee: calls, callers, files, and the shapes of its arguments."""
    return calls.groupBy("callee").agg(
        F.count("*").alias("calls"), F.count_distinct("caller").alias("callers"), F.count_distinct("path").alias("files"),
        F.array_sort(F.collect_set("n_args")).alias("shapes"),
    )


def signature_impact(calls: DataFrame, callee: str, required: int, allowed: int | None) -> DataFrame:
    """Whether calls of a function would break if it took so many arguments; unknown counts are ambiguous."""
    n = F.col("n_args")
    verdict = F.when(n.isNull(), "ambiguous").when(n < required, "would_break")
    if allowed is not None:
        verdict = verdict.when(n > allowed, "would_break")
    return calls.where(F.col("callee") == callee).withColumn("verdict", verdict.otherwise("ok"))


def downstream(calls: DataFrame, max_depth: int = 5) -> DataFrame:
    """(function, reached, depth): what a value that enters a function can reach through calls."""
    out = ancestor_closure(calls.select("caller", "callee").distinct(), "caller", "callee", max_depth)
    return out.select(F.col("node").alias("function"), F.col("ancestor").alias("reached"), "depth")


def import_cycles(imports: DataFrame, max_depth: int = 16) -> DataFrame:
    """Modules that reach themselves through imports, by the shortest way."""
    out = ancestor_closure(imports, "importer", "imported", max_depth)
    return out.where(F.col("node") == F.col("ancestor")).select(F.col("node").alias("module"), F.col("depth").alias("length"))


def exception_census(raises: DataFrame, catches: DataFrame) -> DataFrame:
    """For each exception: how often it is raised, caught, and whether any catch of it is there."""
    r = raises.groupBy("exception").agg(F.count("*").alias("raised"))
    c = catches.groupBy("exception").agg(F.count("*").alias("caught"))
    out = r.join(c, "exception", "full").na.fill(0, ["raised", "caught"])
    return out.withColumn("uncaught", F.col("caught") == 0)


def ranked_search(lines: DataFrame, pattern: str, weights: dict[str, float], top: int) -> DataFrame:
    """The ``top`` matching lines: a sum of weights of the conditions that hold, then path and line."""
    score = F.lit(0.0)
    for cond, w in weights.items():
        score = score + F.when(F.expr(cond), F.lit(float(w))).otherwise(0.0)
    return lines.where(F.col("text").rlike(pattern)).withColumn("score", score).orderBy(F.desc("score"), "path", "line_no").limit(top)
