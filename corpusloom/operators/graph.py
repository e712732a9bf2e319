"""Graphs as edge tables: components, reachability, cycles, levels, phases. All go on until nothing moves; each round is written, so lineage stays short.

Components take few rounds (labels hook and jump); colors, hops and levels take as many rounds as the longest way. A graph of at most LOCAL
edges is instead walked by one Arrow task: that is a bound of some MB, and deep graphs of that size (imports) take no rounds.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import count

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..sources.space import Space

#: Edges and lone nodes of a graph that one task walks.
LOCAL = 200_000


def _small(nodes: DataFrame, edges: DataFrame) -> bool:
    return edges.limit(LOCAL + 1).count() + nodes.limit(LOCAL + 1).count() <= LOCAL


def _walked(nodes: DataFrame, edges: DataFrame, walk: Callable[[list, dict[int, list[int]]], list[tuple]], extra: str) -> DataFrame:
    """node and the columns that walk gives for a small graph: walk(names, next) gets the nodes' names and, by place, the places they lead to."""
    kind = edges.schema["src"].dataType.simpleString()
    both = edges.select("src", "dst").unionByName(nodes.select(F.col("node").alias("src"), F.lit(None).cast(kind).alias("dst")))
    schema = StructType.fromDDL(f"node {kind}, {extra}")
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = [p for b in batches for p in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        names = sorted({x for p in pairs for x in p if x is not None})
        place = {x: k for k, x in enumerate(names)}
        after: dict[int, list[int]] = {}
        for a, b in sorted({(place[a], place[b]) for a, b in pairs if a is not None and b is not None}):
            after.setdefault(a, []).append(b)
        rows = walk(names, after)
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(kinds)], schema=kinds)

    return both.repartition(1).mapInArrow(run, schema)


def _fixpoint(space: Space, name: str, start: DataFrame, step: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Repeats step (rows with a boolean `moved`) until no row has moved; steps only lower labels, so that comes."""
    now = space.keep(start, f"{name}-0")
    for k in count(1):
        new = space.keep(step(now), f"{name}-{k}")
        space.drop(f"{name}-{k - 1}")
        now = new.drop("moved")
        if new.where("moved").limit(1).count() == 0:
            return now


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node reachable in either direction); nodes: node, edges: src, dst.

    Minimum labels: a node takes the least label near it and gives it to the node that its old label names, then looks up its label's own.
    """
    space = Space(edges.sparkSession, "components")
    both = space.keep(edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct(), "both")

    def step(now: DataFrame) -> DataFrame:
        near = both.join(now.select(F.col("node").alias("dst"), "comp"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("comp").alias("near"))
        low = now.join(near, "node", "left").select("node", "comp", F.least("comp", "near").alias("low"))
        given = low.select("node", "low").union(low.select("comp", "low")).groupBy("node").agg(F.min("low").alias("to"))
        new = now.withColumnRenamed("comp", "old").join(given, "node")
        new = new.join(given.select(F.col("node").alias("old"), F.col("to").alias("top")), "old").select("node", "old", F.least("to", "top").alias("comp"))
        return new.select("node", "comp", (F.col("old") != F.col("comp")).alias("moved"))

    return _fixpoint(space, "labels", nodes.select("node", F.col("node").alias("comp")).distinct(), step)


def reach(seeds: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """node, hops: the fewest steps from any seed (node) along edges (src, dst), up to `most`. Each round looks only at the last round's new nodes."""
    if most is None and _small(seeds, edges):
        return _near(seeds, edges)
    space = Space(edges.sparkSession, "reach")
    edges = space.keep(edges.select("src", "dst").distinct(), "edges")
    seen = space.keep(seeds.select("node", F.lit(0).alias("hops")).distinct(), "seen-0")
    for k in count(1) if most is None else range(1, most + 1):
        fresh = seen.where(F.col("hops") == k - 1).join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = space.keep(seen.unionByName(fresh.select("node", F.lit(k).alias("hops"))), f"seen-{k}")
        space.drop(f"seen-{k - 1}")
        seen = new
        if seen.where(F.col("hops") == k).limit(1).count() == 0:
            break
    return seen


def _near(seeds: DataFrame, edges: DataFrame) -> DataFrame:
    """reach() of a small graph."""
    start = seeds.select("node").distinct()
    marks = start.select(F.col("node").alias("src"), F.col("node").alias("dst"))  # a loop marks a seed

    def walk(names: list, after: dict[int, list[int]]) -> list[tuple]:
        at = {k: 0 for k, to in after.items() if k in to}
        front = list(at)
        while front:
            front = [n for k in front for n in after.get(k, ()) if n not in at and not at.update({n: at[k] + 1})]
        return [(names[k], h) for k, h in at.items()]

    return _walked(start, edges.select("src", "dst").where("src <> dst").unionByName(marks), walk, "hops int")


def _tarjan(names: list, after: dict[int, list[int]]) -> list[tuple]:
    """node, scc (its smallest node), size, by one depth-first walk without recursion."""
    index: dict[int, int] = {}
    low: dict[int, int] = {}
    on: dict[int, bool] = {}
    stack, out = [], []
    for root in range(len(names)):
        work = [(root, iter(after.get(root, ())))] if root not in index else []
        if work:
            index[root] = low[root] = len(index)
            stack.append(root)
            on[root] = True
        while work:
            v, rest = work[-1]
            w = next(rest, None)
            if w is not None and w not in index:
                index[w] = low[w] = len(index)
                stack.append(w)
                on[w] = True
                work.append((w, iter(after.get(w, ()))))
            elif w is not None:
                low[v] = min(low[v], index[w]) if on[w] else low[v]
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[v])
                if low[v] == index[v]:
                    group = []
                    while not group or group[-1] != v:
                        group.append(stack.pop())
                        on[group[-1]] = False
                    out += [(names[g], names[min(group)], len(group)) for g in group]
    return out


def cycles(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, scc, size: the strongly connected component (its smallest node) of every node.

    Colors spread forward: a node takes the smallest node that reaches it. Within a color, what reaches back to
    that node is its component; it is set aside and the rest goes round again. Work grows with edges and
    rounds, not with pairs of nodes.
    """
    if _small(nodes, edges):
        return _walked(nodes, edges, _tarjan, f"scc {edges.schema['src'].dataType.simpleString()}, size long").join(nodes.select("node").distinct(), "node", "left_semi")
    space = Space(edges.sparkSession, "cycles")
    left = space.keep(nodes.select("node").distinct(), "left-0")
    live = space.keep(edges.select("src", "dst").where("src <> dst").distinct(), "live-0")
    done: list[DataFrame] = []
    for k in count(1):

        def spread(now: DataFrame, live: DataFrame = live) -> DataFrame:
            came = live.join(now.select(F.col("node").alias("src"), "color"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("color").alias("came"))
            return now.join(came, "node", "left").select("node", F.least("color", "came").alias("color"), F.coalesce(F.col("came") < F.col("color"), F.lit(False)).alias("moved"))

        color = _fixpoint(space, f"color-{k}", left.select("node", F.col("node").alias("color")), spread)
        inner = live.join(color.select(F.col("node").alias("src"), F.col("color").alias("c")), "src").join(color.select(F.col("node").alias("dst"), F.col("color").alias("d")), "dst").where("c = d").select("src", "dst")
        back = reach(color.where("node = color").select("node"), inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        found = space.keep(back.select("node").join(color, "node").select("node", F.col("color").alias("scc")), f"found-{k}")
        done.append(found)
        left = space.keep(left.join(found, "node", "left_anti"), f"left-{k}")
        if left.limit(1).count() == 0:
            break
        live = space.keep(live.join(left.select(F.col("node").alias("src")), "src", "left_semi").join(left.select(F.col("node").alias("dst")), "dst", "left_semi"), f"live-{k}")
    out = done[0] if done else nodes.select("node", F.col("node").alias("scc"))
    for d in done[1:]:
        out = out.unionByName(d)
    sizes = out.groupBy("scc").agg(F.count("*").alias("size"))
    return out.join(sizes, "scc").select("node", "scc", "size")


def cycle_kind(all_type_only: Column, has_barrel: Column) -> Column:
    return F.when(all_type_only, "shared-type").when(has_barrel, "barrel").otherwise("genuine")


def classify_cycles(sccs: DataFrame, edges: DataFrame, barrels: DataFrame) -> DataFrame:
    """scc, size, kind of each cycle of two nodes or more; edges: src, dst, type_only; barrels: node. Only edges within the cycle count."""
    own = sccs.where("size > 1")
    inner = edges.join(own.select(F.col("node").alias("src"), "scc", "size"), "src").join(own.select(F.col("node").alias("dst"), F.col("scc").alias("other")), "dst").where("scc = other")
    typed = inner.groupBy("scc", "size").agg(F.bool_and("type_only").alias("typed"))
    barrel = own.join(barrels, "node", "left_semi").select("scc").distinct().withColumn("barrel", F.lit(True))
    return typed.join(barrel, "scc", "left").select("scc", "size", cycle_kind(F.col("typed"), F.coalesce("barrel", F.lit(False))).alias("kind"))


def _heights(names: list, after: dict[int, list[int]]) -> list[tuple]:
    """node, level of those that are in no cycle and above none, a level at a time."""
    before: dict[int, list[int]] = {}
    for a, to in after.items():
        for b in to:
            before.setdefault(b, []).append(a)
    need = {k: len(after.get(k, ())) for k in range(len(names))}
    front, level, out = [k for k in need if not need[k]], 0, []
    while front:
        out += [(names[k], level) for k in front]
        met = []
        for k in front:
            for a in before.get(k, ()):
                need[a] -= 1
                if not need[a]:
                    met.append(a)
        front, level = met, level + 1
    return out


def levels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, level of an acyclic graph: 0 for nodes that depend on nothing (src depends on dst), else one more than the highest dependency. Nodes in or above a cycle have none."""
    if _small(nodes, edges):
        return _walked(nodes, edges.where("src <> dst"), _heights, "level int").join(nodes.select("node").distinct(), "node", "left_semi")
    space = Space(edges.sparkSession, "levels")
    edges = space.keep(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    need = edges.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("need"))
    waiting = space.keep(nodes.select("node").distinct().join(need, "node", "left").select("node", F.coalesce("need", F.lit(0)).alias("need")), "waiting-0")
    found = []
    for k in count():
        ready = space.keep(waiting.where("need = 0").select("node", F.lit(k).alias("level")), f"ready-{k}")
        if ready.limit(1).count() == 0:
            break
        found.append(f"{space.root}/ready-{k}")
        met = edges.join(ready.select(F.col("node").alias("dst")), "dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("met"))
        waiting = space.keep(waiting.where("need > 0").join(met, "node", "left").select("node", (F.col("need") - F.coalesce("met", F.lit(0))).alias("need")), f"waiting-{k + 1}")
        space.drop(f"waiting-{k}")
    return space.spark.read.schema(ready.schema).parquet(*found) if found else ready


def fan_out(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, importers: how many nodes depend on it."""
    n = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("importers"))
    return nodes.select("node").join(n, "node", "left").select("node", F.coalesce("importers", F.lit(0)).alias("importers"))


def ready_order(lv: DataFrame, fans: DataFrame, hops: DataFrame | None = None, missing: int = 99) -> DataFrame:
    """node, level, importers, hops, place: the order of work within each level: most importers first, then most hops from an entry (none: `missing`), then by name."""
    own = lv.join(fans, "node", "left").withColumn("importers", F.coalesce("importers", F.lit(0)))
    own = own.join(hops.select("node", "hops"), "node", "left") if hops is not None else own.withColumn("hops", F.lit(None).cast("int"))
    own = own.withColumn("hops", F.coalesce("hops", F.lit(missing)))
    firsts = own.groupBy("level").agg(F.array_sort(F.collect_list(F.struct((-F.col("importers")).alias("i"), (-F.col("hops")).alias("h"), "node"))).alias("x"))
    rows = firsts.select("level", F.posexplode("x").alias("place", "x"))
    return rows.select("x.node", "level", (-F.col("x.i")).alias("importers"), (-F.col("x.h")).alias("hops"), (F.col("place") + 1).alias("place"))


def fix_phase(cycles_: DataFrame) -> DataFrame:
    """phase 0, kind, cycles: a row for the cycles that can be resolved by themselves before all phases (shared types and barrels); none without any."""
    fixable = cycles_.where("kind <> 'genuine'").agg(F.count("*").alias("cycles")).where("cycles > 0")
    return fixable.select(F.lit(0).alias("phase"), F.lit("cycle-fixes").alias("kind"), "cycles")


#: The order of kinds within a level.
KINDS = ["navigator", "component", "module", "cold-path-screen", "screen", "hot-path-screen"]


def file_kind(path: Column, hops: Column | None = None) -> Column:
    """The kind of a file by its path and, for screens, its hops from an entry."""
    screen = F.lit("screen") if hops is None else F.when(hops.isNull(), "screen").when(hops <= 1, "hot-path-screen").otherwise("cold-path-screen")
    return F.when(path.rlike("[Nn]avigat|[Ll]ayout"), "navigator").when(path.rlike(r"(?:^|[/\\])(?:screens?|pages?|app)[/\\]"), screen).when(path.rlike(r"(?:^|[/\\])components?[/\\]"), "component").otherwise("module")


def phases(nodes: DataFrame, edges: DataFrame, kind: Column | None = None) -> DataFrame:
    """node, phase, kind: nodes by level and kind; those in cycles, or above them, come last together."""
    lv = levels(nodes, edges)
    own = nodes.select("node").distinct().join(lv, "node", "left").withColumn("kind", kind if kind is not None else F.lit("module"))
    rank = F.coalesce(F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")), F.lit(0))
    own = own.withColumn("cyclic", F.col("level").isNull()).withColumn("kind", F.when(F.col("cyclic"), "cycle").otherwise(F.col("kind"))).withColumn("rank", rank)
    steps = own.select("cyclic", "level", "rank", "kind").distinct()  # a row for each level and kind
    steps = steps.select(F.col("level").alias("at"), F.col("kind").alias("of"), F.row_number().over(Window.orderBy("cyclic", "level", "rank", "kind")).alias("phase"))
    return own.join(F.broadcast(steps), F.col("level").eqNullSafe(F.col("at")) & (F.col("kind") == F.col("of"))).select("node", "phase", "kind")
