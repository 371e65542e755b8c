"""Values along dependency graphs, and what can be reached in a graph.

Many small graphs are packed into tasks and each is solved whole in memory. A graph beyond a measured size is
solved by joins, in rounds that contract it: a node that waits for one other node only is a function of that
node, and such functions are composed by pointer doubling, so that a chain takes the logarithm of its length.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import cut_lineage, forget, fresh_path

WHOLE = 500_000  # rows (nodes and edges) of a graph that one task may hold
REACH_ROWS = 200_000  # rows of a graph that may travel with the tasks


class Rule(NamedTuple):
    """How a node's value follows from its parents', in memory and as columns.

    Seen from a node, a parent's value x counts as the function (a, s) of the edge between them; ``base`` is the
    most that settled parents count for.
    """

    name: str

    def edge(self, x: Column) -> Column:
        return F.greatest(F.col("a"), x + F.col("s")) if self.name == "level" else F.col("a") + F.col("s") * x

    def value(self, base: Column) -> Column:
        return base if self.name == "level" else 1 - base

    def early(self) -> Column:
        """Known whatever the open parents are."""
        return F.lit(False) if self.name == "level" else F.col("base") == 1

    def only(self) -> list[Column]:
        """The function of a node with one open parent."""
        if self.name == "level":
            return [F.greatest("a", "base").alias("fa"), F.col("s").alias("fs")]
        return [(1 - F.col("a")).alias("fa"), (-F.col("s")).alias("fs")]

    def after(self, a: str, s: str, fa: str, fs: str) -> tuple[Column, Column]:
        """(a, s) after the function (fa, fs) of what it was applied to."""
        a, s, fa, fs = (F.col(c) for c in (a, s, fa, fs))
        return (F.greatest(a, fa + s), fs + s) if self.name == "level" else (a + s * fa, s * fs)


LEVEL = Rule("level")  # 0 without parents, else one more than the highest parent
UNBLOCKED = Rule("unblocked")  # 1 if no parent has 1, else 0


def solve_whole(rows: list[tuple], rule: Rule) -> dict:
    """{node: value or None} of one graph from (node, parent or None); cycles and absent parents leave None."""
    parents: dict = defaultdict(set)
    for node, parent in rows:
        own = parents[node]
        if parent is not None:
            own.add(parent)
    children, waits = defaultdict(list), {}
    for node, own in parents.items():
        waits[node] = len(own)
        for p in own:
            children[p].append(node)
    found, base = dict.fromkeys(parents), dict.fromkeys(parents, 0)
    ready = [n for n, count in waits.items() if not count]
    while ready:
        node = ready.pop()
        if rule.name == "level":
            found[node] = base[node]
            settled = [node]
            for c in children.get(node, ()):
                base[c] = max(base[c], base[node] + 1)
        else:
            found[node] = 1
            settled = [c for c in children.get(node, ()) if found[c] is None]
            for c in settled:
                found[c] = 0
        for one in settled:
            for c in children.get(one, ()):
                waits[c] -= 1
                if not waits[c] and found[c] is None:
                    ready.append(c)
    return found


def _in_tasks(rows: DataFrame, rule: Rule) -> DataFrame:
    """Solve each graph of ``rows(graph, node, parent)`` in the task that holds it."""
    graph, node = dict(rows.dtypes)["graph"], dict(rows.dtypes)["node"]

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        def out(keys: list, held: list):
            nodes, values, graphs = [], [], []
            for key, own in zip(keys, held):
                found = solve_whole(own, rule)
                graphs += [key] * len(found)
                nodes += found.keys()
                values += found.values()
            return pa.RecordBatch.from_arrays(
                [pa.array(graphs, kinds[0]), pa.array(nodes, kinds[1]), pa.array(values, pa.int32())], ["graph", "node", "value"])

        keys, held = [], []
        for batch in batches:
            kinds = [batch.schema.field(i).type for i in (0, 1)]
            for key, one, parent in zip(*(c.to_pylist() for c in batch.columns)):
                if not keys or key != keys[-1]:
                    keys.append(key)
                    held.append([])
                held[-1].append((one, parent))
            if len(keys) > 1:  # the last graph may go on
                yield out(keys[:-1], held[:-1])
                keys, held = keys[-1:], held[-1:]
        if keys:
            yield out(keys, held)

    packed = rows.select("graph", "node", "parent").repartition("graph").sortWithinPartitions("graph")
    return packed.mapInArrow(run, f"graph {graph}, node {node}, value int")


def _by_rounds(rows: DataFrame, rule: Rule) -> DataFrame:
    """Solve large graphs by joins. A round settles what waits for nothing and then contracts the rest."""
    spark = rows.sparkSession
    key = lambda column: F.to_json(F.struct("graph", F.col(column).alias("node")))
    every = cut_lineage(rows.select("graph", "node", key("node").alias("k")).distinct())
    nodes = every.select("k", F.lit(0).alias("base"))
    edges = cut_lineage(rows.where("parent IS NOT NULL").select(
        key("node").alias("k"), key("parent").alias("p"), F.lit(0).alias("a"), F.lit(1).alias("s")).distinct())
    settled, round_no = fresh_path(spark, "settled"), 0
    done = lambda: spark.read.schema("k string, value int, round int").parquet(settled)
    while True:
        waiting = edges.select("k").distinct().withColumn("waits", F.lit(True))
        now = nodes.join(waiting, "k", "left").where(F.col("waits").isNull() | rule.early())
        now.select("k", rule.value(F.col("base")).cast("int").alias("value")).write.parquet(f"{settled}/round={round_no}")
        ready = done().where(F.col("round") == round_no).drop("round")
        if ready.isEmpty():
            break
        left = edges.join(ready.select("k"), "k", "left_anti")
        given = left.join(ready.select(F.col("k").alias("p"), "value"), "p").groupBy("k").agg(F.max(rule.edge(F.col("value"))).alias("given"))
        new_nodes = cut_lineage(nodes.join(ready.select("k"), "k", "left_anti").join(given, "k", "left").select(
            "k", F.greatest("base", F.coalesce("given", F.lit(0))).alias("base")))
        left = cut_lineage(left.join(ready.select(F.col("k").alias("p")), "p", "left_anti").select("k", "p", "a", "s"))
        new_edges = _contracted(left, new_nodes, rule)
        forget(spark, edges, left, *([nodes] if round_no else []))  # the first nodes are a view of `every`
        nodes, edges, round_no = new_nodes, new_edges, round_no + 1
    return every.join(done().drop("round"), "k", "left").select("graph", "node", "value")


def _contracted(edges: DataFrame, nodes: DataFrame, rule: Rule) -> DataFrame:
    """Edges from nodes that wait for one node only now come from where the chain of such nodes begins."""
    spark = edges.sparkSession
    single = edges.groupBy("k").agg(F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in ("p", "a", "s")]).where("n = 1")
    at = cut_lineage(single.join(nodes.where(~rule.early()), "k").select("k", "p", *rule.only()))
    count = at.count()
    on = lambda table, column: table.select(F.col("k").alias(column), F.col("p").alias("far"), F.col("fa").alias("ga"), F.col("fs").alias("gs"))
    for _ in range(count.bit_length()):
        jumped = at.join(on(at, "p"), "p", "left")
        a, s = rule.after("fa", "fs", "ga", "gs")
        moved = F.col("far").isNotNull()
        grown = cut_lineage(jumped.select(
            "k", F.coalesce("far", "p").alias("p"), F.when(moved, a).otherwise(F.col("fa")).alias("fa"),
            F.when(moved, s).otherwise(F.col("fs")).alias("fs"), moved.alias("moved")))
        forget(spark, at)
        still, at = not grown.where("moved").isEmpty(), grown.drop("moved")
        if not still:
            break
    # what still points into the chain after that many doublings goes round in a cycle and stays as it is
    open_end = at.join(at.select(F.col("k").alias("p")), "p", "left_anti")
    a, s = rule.after("a", "s", "ga", "gs")
    moved = F.col("far").isNotNull()
    joined = edges.join(on(open_end, "p"), "p", "left")
    out = cut_lineage(joined.select(
        "k", F.coalesce("far", "p").alias("p"), F.when(moved, a).otherwise(F.col("a")).alias("a"),
        F.when(moved, s).otherwise(F.col("s")).alias("s")).distinct())
    forget(spark, at)
    return out


def solve(rows: DataFrame, rule: Rule, whole: int = WHOLE) -> DataFrame:
    """(graph, node, value) from (graph, node, parent); a node has a row with a null parent and one per parent.

    Graphs of up to ``whole`` rows are solved in tasks, after one shuffle; larger ones by joins in rounds. A node
    on a cycle, with a parent that is no node, or behind either, has a null value.
    """
    large = rows.groupBy("graph").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > whole).select(F.col("graph").alias("_large"))
    if large.isEmpty():
        return _in_tasks(rows, rule)
    large = cut_lineage(large)
    same = F.col("graph").eqNullSafe(F.col("_large"))
    small, big = rows.join(large, same, "left_anti"), rows.join(large, same, "left_semi")
    return _in_tasks(small, rule).unionByName(_by_rounds(big, rule))


def reach(rows: DataFrame, most: int = REACH_ROWS) -> DataFrame:
    """(node, found): every node with all nodes that its parents lead to, itself included, from (node, parent).

    A node has a row with a null parent or one per parent; parents that are no nodes lead nowhere. A table of up
    to ``most`` rows travels with the tasks, which search from their share of the nodes. Beyond that only the
    pairs found last meet the edges again, until nothing is new.
    """
    spark, kind = rows.sparkSession, dict(rows.dtypes)["node"]
    rows = rows.select("node", "parent").where("node IS NOT NULL")
    nodes = rows.select("node").distinct()
    few = rows.limit(most + 1).collect()
    if len(few) <= most:
        parents = defaultdict(set)
        for row in few:
            parents[row.node].add(row.parent)
        held = spark.sparkContext.broadcast({n: [p for p in own if p in parents and p != n] for n, own in parents.items()})

        def run(batches: Iterator) -> Iterator:
            import pyarrow as pa

            for batch in batches:
                kind_of = batch.schema.field(0).type
                for node in batch.column(0).to_pylist():
                    seen, todo = {node}, [node]
                    while todo:
                        for p in held.value[todo.pop()]:
                            if p not in seen:
                                seen.add(p)
                                todo.append(p)
                    yield pa.RecordBatch.from_arrays([pa.array([node] * len(seen), kind_of), pa.array(list(seen), kind_of)], ["node", "found"])

        return nodes.mapInArrow(run, f"node {kind}, found {kind}")
    edges = cut_lineage(rows.where("node <> parent").distinct().join(nodes.withColumnRenamed("node", "parent"), "parent", "left_semi"))
    path, round_no = fresh_path(spark, "reached"), 0
    known = lambda: spark.read.schema(f"node {kind}, found {kind}, round int").parquet(path)
    nodes.select("node", F.col("node").alias("found")).write.parquet(f"{path}/round=0")
    while True:
        newest = known().where(F.col("round") == round_no).drop("round")
        if round_no and newest.isEmpty():
            return known().drop("round")
        further = newest.join(edges.withColumnRenamed("node", "found"), "found").select("node", F.col("parent").alias("found")).distinct()
        round_no += 1
        further.join(known().drop("round"), ["node", "found"], "left_anti").write.parquet(f"{path}/round={round_no}")
