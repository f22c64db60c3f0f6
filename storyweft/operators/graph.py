"""Graph operators on edge tables (a, b[, weight]); iterations are joins, checkpointed each round."""

from __future__ import annotations

from functools import reduce
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from storyweft.functions.lineage import MAX_BROADCAST, cut


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()


def facing(edges: DataFrame) -> DataFrame:
    """Edges (a, b[, weight]) in both directions, repeats included: a narrow step."""
    more = edges.columns[2:]
    return edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), *more))


def sent(nodes: DataFrame, n: int) -> DataFrame:
    """A table of two numbers for each of ``n`` nodes, broadcast where it is small, so that the edges it joins aren't shuffled."""
    return F.broadcast(nodes) if 16 * n <= MAX_BROADCAST // 4 else nodes


def degree_centrality(edges: DataFrame) -> DataFrame:
    """Degree over n - 1 for each node of an undirected graph."""
    own = edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    degree = cut(own.select(F.explode(F.array_distinct(F.array("a", "b"))).alias("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree")))
    total = degree.agg(F.count(F.lit(1)).alias("n"))  # one row
    return degree.join(F.broadcast(total)).select("node", "degree", F.when(F.col("n") > 1, F.col("degree") / (F.col("n") - 1)).otherwise(F.lit(0.0)).alias("centrality"))


def graph_statistics(edges: DataFrame) -> DataFrame:
    """Nodes, distinct directed edges and their density, in one row."""
    own = edges.select("a", "b").distinct()
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).agg(F.count_distinct("node").alias("nodes"))
    n = F.col("nodes")
    return own.agg(F.count(F.lit(1)).alias("edges")).join(F.broadcast(nodes)).select("nodes", "edges", F.when(n > 1, F.col("edges") / (n * (n - 1))).otherwise(F.lit(0.0)).alias("density"))


def propagation_graph(rows: DataFrame, hours: float = 1.0) -> DataFrame:
    """Edges of each narrative's graph: source to narrative weighted by posts, and sources that followed another in time."""
    from storyweft.operators.joins import followed_within

    star = rows.groupBy("narrative_id", F.col("source_id").alias("a")).agg(F.count(F.lit(1)).alias("weight")).select("narrative_id", "a", F.col("narrative_id").alias("b"), "weight", F.lit("posts").alias("kind"))
    temporal = followed_within(rows, hours).select("narrative_id", F.col("earlier").alias("a"), F.col("later").alias("b"), F.lit(1).cast("long").alias("weight"), F.lit("follows").alias("kind"))
    return star.unionByName(temporal)


def khop(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """Nodes within ``depth`` steps of the starts (column node) in either direction, with their distance."""
    near = both_ways(edges)
    seen = cut(starts.select("node").distinct().withColumn("distance", F.lit(0)))
    frontier = seen
    for d in range(1, depth + 1):
        found = frontier.select(F.col("node").alias("a")).join(near, "a").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti")
        frontier = cut(found.withColumn("distance", F.lit(d)))
        seen = cut(seen.unionByName(frontier))
    return seen


def descendants(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """Nodes that the starts (column node) reach along directed edges at any depth, themselves included."""
    near = cut(edges.select("a", "b").distinct())
    seen = frontier = cut(starts.select("node").distinct())
    while not frontier.isEmpty():
        frontier = cut(near.join(frontier.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct().join(seen, "node", "left_anti"))
        seen = cut(seen.unionByName(frontier))
    return seen


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose ends are both among the nodes."""
    return edges.join(nodes.select(F.col("node").alias("a")), "a", "left_semi").join(nodes.select(F.col("node").alias("b")), "b", "left_semi")


def connected_components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, component): smallest node reachable; labels spread to neighbours, then jump to their label's label.

    Edges stay where they are while the labels fit in a broadcast: each task reduces its edges to a label for each node.
    """
    near = facing(cut(edges.select("a", "b")))
    labels = cut(near.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    n = labels.count()
    for _ in range(max_rounds):
        spread = near.join(sent(labels.select(F.col("node").alias("b"), "component"), n), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("c"))
        step = labels.join(spread, "node").select("node", F.least("component", "c").alias("component"), (F.col("c") < F.col("component")).alias("moved"))
        jump = step.select(F.col("node").alias("component"), F.col("component").alias("further"))
        new = cut(step.join(jump, "component", "left").select("node", F.least(F.col("component"), F.coalesce("further", "component")).alias("component"), (F.col("moved") | F.coalesce(F.col("further") < F.col("component"), F.lit(False))).alias("moved")))
        moved = new.filter(F.col("moved")).limit(1).count()
        labels = new.select("node", "component")
        if not moved:
            return labels
    raise RuntimeError("the components did not settle")


def strong_components(edges: DataFrame, max_rounds: int = 200) -> DataFrame:
    """(node, component) of a directed graph: labels spread forwards and backwards; nodes where both agree are done.

    Edges stay where they are while the labels fit in a broadcast: each task reduces its edges to a label for each node.
    """
    left = cut(edges.select("a", "b").filter("a <> b"))
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    done = None
    rest = cut(nodes)
    for _ in range(max_rounds):
        marks, n = [], rest.count()
        for source, target in (("a", "b"), ("b", "a")):
            label = rest.select("node", F.col("node").alias("mark"))
            while True:  # the largest label that reaches a node
                spread = left.join(sent(label.select(F.col("node").alias(source), "mark"), n), source).groupBy(F.col(target).alias("node")).agg(F.max("mark").alias("m"))
                new = cut(label.join(spread, "node", "left").select("node", F.greatest("mark", F.coalesce("m", "mark")).alias("mark"), F.coalesce(F.col("m") > F.col("mark"), F.lit(False)).alias("moved")))
                moved = new.filter("moved").limit(1).count()
                label = new.drop("moved")
                if not moved:
                    break
            marks.append(label)
        both = cut(marks[0].join(marks[1].withColumnRenamed("mark", "back"), "node"))
        found = both.filter("mark = back").select("node", F.col("mark").alias("component"))
        done = cut(found if done is None else done.unionByName(found))
        rest = cut(both.filter("mark <> back").select("node"))
        if rest.isEmpty():
            return done
        # Components lie within one pair of marks: edges between different pairs are done with.
        side = lambda end, k: sent(both.filter("mark <> back").select(F.col("node").alias(end), F.col("mark").alias(f"m{k}"), F.col("back").alias(f"k{k}")), 2 * n)  # noqa: B023, E731
        left = cut(left.join(side("a", 1), "a").join(side("b", 2), "b").filter("m1 = m2 AND k1 = k2").select("a", "b"))
    raise RuntimeError("the strong components did not settle")


def shortest_paths(edges: DataFrame, starts: DataFrame, directed: bool = True) -> DataFrame:
    """(start, node, path): a shortest path from each start (column node) to every node it reaches, at any depth; of equals the one with the smallest nodes.

    Paths of one length end at different nodes, so a start's smallest path to a node is the smallest one to a node before it, and one more.
    Only the rank of that one among its start's travels along the edges; paths are put together by joins with the last level's.
    A start that has met as many nodes as its component holds goes no further.
    """
    own = cut(edges.select("a", "b").distinct())
    near = own if directed else cut(both_ways(own))
    labels = connected_components(own)
    sizes = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    level = cut(starts.select(F.col("node").alias("start"), "node", F.array("node").alias("path"), F.lit(1).alias("rank")).distinct())
    most = cut(level.join(labels, "node").join(sizes, "component").select("start", "size"))
    seen, levels = level.select("start", "node"), [level]
    by_path = Window.partitionBy("start").orderBy("before", "node")
    while True:
        going = most.join(seen.groupBy("start").agg(F.count(F.lit(1)).alias("met")), "start").filter("met < size").select("start")
        met = level.join(going, "start", "left_semi").select("start", F.col("node").alias("a"), "rank").join(near, "a").groupBy("start", F.col("b").alias("node")).agg(F.min("rank").alias("before"))
        fresh = met.join(seen, ["start", "node"], "left_anti")
        last = level.select("start", F.col("rank").alias("before"), "path")
        level = cut(fresh.withColumn("rank", F.row_number().over(by_path)).join(last, ["start", "before"]).select("start", "node", F.concat("path", F.array("node")).alias("path"), "rank"))
        if level.isEmpty():
            return reduce(DataFrame.unionByName, levels).select("start", "node", "path")
        levels.append(level)
        seen = cut(seen.unionByName(level.select("start", "node")))


def shortest_path(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """Path for each pair (a, b), along the edges or, failing that, from b to a."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    paths = shortest_paths(edges, ends)
    forth = pairs.join(paths.select(F.col("start").alias("a"), F.col("node").alias("b"), F.col("path").alias("forth")), ["a", "b"], "left")
    back = forth.join(paths.select(F.col("start").alias("b"), F.col("node").alias("a"), F.col("path").alias("back")), ["a", "b"], "left")
    return back.select("a", "b", F.coalesce("forth", "back").alias("path"))


#: Nodes of a component whose adjacency a task may hold (a byte for each two nodes), and sources that it takes at once.
DENSE, AT_ONCE = 12_288, 256


def betweenness(edges: DataFrame, sources: DataFrame, block: int = 10_000, dense: int = DENSE) -> DataFrame:
    """Brandes' betweenness of an undirected graph from the given sources (column node): exact when they are all nodes.

    Sources see their own component only. Components of at most ``dense`` nodes go through matrix products, a task for
    each block of their sources. In larger ones the state has a row for each source and node, so sources are
    taken in blocks of about ``block``, whose sums add up.
    """
    own = cut(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct())
    labels = connected_components(own)
    place = F.row_number().over(Window.partitionBy("component").orderBy("node")) - 1
    members = cut(labels.select("component", "node", place.alias("i"), F.count(F.lit(1)).over(Window.partitionBy("component")).alias("n")))
    asked = cut(sources.select("node").distinct().join(members, "node"))
    parts = [_small_components(own, asked.filter(F.col("n") <= dense), members.filter(F.col("n") <= dense))]
    large = asked.filter(F.col("n") > dense).select("node")
    n = large.count()
    if n:
        near = facing(own)
        inner = cut(near.join(members.filter(F.col("n") > dense).select(F.col("node").alias("a")), "a", "left_semi"))
        blocks = max(1, -(-n // block))
        parts += [cut(_dependencies(inner, large.filter(F.pmod(F.xxhash64("node"), F.lit(blocks)) == k))) for k in range(blocks)]
    return reduce(DataFrame.unionByName, parts).groupBy("node").agg(F.sum("betweenness").alias("betweenness"))


def _small_components(own: DataFrame, asked: DataFrame, members: DataFrame) -> DataFrame:
    """(node, betweenness) of components' members (component, node, i: place in it, n: nodes of it); each node's larger neighbours travel as a list, once for each block of sources."""
    nodes = members.agg(F.count(F.lit(1))).first()[0]
    if not nodes:
        return members.select("node", F.lit(0.0).alias("betweenness"))
    side = lambda name, place, *more: sent(members.select(F.col("node").alias(name), F.col("i").alias(place), *more), nodes)
    lists = own.join(side("a", "i", F.col("component").alias("component")), "a").join(side("b", "j"), "b").groupBy("component", "i").agg(F.collect_list("j").alias("j"))
    asked = asked.select("component", F.floor(F.col("i") / AT_ONCE).alias("part"), "i", "n")
    links = lists.join(asked.select(F.col("component").alias("of"), F.col("part").alias("block")).distinct(), F.col("component") == F.col("of")).select("of", "block", "i", "j")

    def product(beside: np.ndarray, state: np.ndarray) -> np.ndarray:
        rows = max(1, 8_388_608 // len(beside))  # 64 MB of doubles
        return np.concatenate([beside[k : k + rows].astype(float) @ state for k in range(0, len(beside), rows)])

    def sums(own: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        s, across, n = own["i"].to_numpy(), np.arange(len(own)), int(own["n"].iloc[0]) if len(own) else 1
        beside = np.zeros((n, n), bool)
        for i, j in zip(edges["i"], edges["j"], strict=True):
            beside[i, j] = True
            beside[j, i] = True
        depth, paths = np.full((n, len(s)), -1, np.int32), np.zeros((n, len(s)))
        depth[s, across], paths[s, across] = 0, 1
        level, d = paths.copy(), 0
        while (depth < 0).any():
            found = product(beside, level)
            new = (found > 0) & (depth < 0)
            if not new.any():
                break
            d += 1
            depth[new] = d
            level = np.where(new, found, 0)
            paths += level
        delta = np.zeros_like(paths)
        for k in range(d, 1, -1):  # what the first level passes goes to the sources, which don't count
            unit = np.divide(1 + delta, paths, out=np.zeros_like(paths), where=depth == k)
            delta += np.where(depth == k - 1, paths * product(beside, unit), 0)
        at = np.flatnonzero((depth > 0).any(1))
        return pd.DataFrame({"component": own["component"].iloc[0], "i": at, "betweenness": delta[at].sum(1) / 2})

    kind = members.schema["component"].dataType.simpleString()
    made = asked.groupBy("component", "part").cogroup(links.groupBy("of", "block")).applyInPandas(sums, f"component {kind}, i int, betweenness double")
    return made.groupBy("component", "i").agg(F.sum("betweenness").alias("betweenness")).join(members, ["component", "i"]).select("node", "betweenness")


def _dependencies(near: DataFrame, sources: DataFrame) -> DataFrame:
    """(node, betweenness): the part of the betweenness that shortest paths from these sources give."""
    level = cut(sources.select(F.col("node").alias("s"), F.col("node").alias("v"), F.lit(0).alias("d"), F.lit(1.0).alias("paths")))
    levels, seen = [level], level.select("s", "v")
    for d in count(1):
        found = level.join(near, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
        level = cut(found.join(seen, ["s", "v"], "left_anti").select("s", "v", F.lit(d).alias("d"), "paths"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = cut(seen.unionByName(level.select("s", "v")))
    share = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("delta"))
    total = share.select("s", "v", "delta")
    for upper in reversed(levels[:-1]):
        passed = share.select("s", F.col("v").alias("a"), ((1 + F.col("delta")) / F.col("paths")).alias("unit")).join(near, "a").select("s", F.col("b").alias("v"), "unit")
        up = upper.join(passed.groupBy("s", "v").agg(F.sum("unit").alias("unit")), ["s", "v"], "left")
        share = cut(up.select("s", "v", "paths", (F.col("paths") * F.coalesce("unit", F.lit(0.0))).alias("delta")))
        total = total.unionByName(share.select("s", "v", "delta"))
    return total.filter("s <> v").groupBy(F.col("v").alias("node")).agg((F.sum("delta") / 2).alias("betweenness"))


def eigenvector_centrality(edges: DataFrame, rounds: int = 20) -> DataFrame:
    """Power iteration over the undirected graph plus each node itself (which settles on bipartite graphs, too).

    Edges stay where they are while the scores fit in a broadcast. Scores are stored and scaled every fourth round, which only changes their unit.
    """
    near = both_ways(edges)
    near = cut(near.unionByName(near.select("a", F.col("a").alias("b")).distinct()))
    score = cut(near.select(F.col("a").alias("node")).distinct().withColumn("score", F.lit(1.0)))
    n = score.count()
    for k in range(1, rounds + 1):
        raw = near.join(sent(score.select(F.col("node").alias("b"), "score"), n), "b").groupBy(F.col("a").alias("node")).agg(F.sum("score").alias("score"))
        if k % 4 and k < rounds:
            score = raw
            continue
        raw = cut(raw)  # used twice below
        norm = raw.agg(F.sqrt(F.sum(F.col("score") * F.col("score"))).alias("norm"))  # one row
        score = raw.join(F.broadcast(norm)).select("node", (F.col("score") / F.col("norm")).alias("score"))
    return score


def optimize_sources(edges: DataFrame, names: DataFrame, k: int) -> DataFrame:
    """The k nodes with the highest sum of betweenness (relative to the largest) and eigenvector centrality."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    b = cut(betweenness(edges, nodes))  # used twice below
    top = b.agg(F.max("betweenness").alias("top"))
    both = b.join(eigenvector_centrality(edges), "node").join(F.broadcast(top))
    score = F.when(F.col("top") > 0, F.col("betweenness") / F.col("top")).otherwise(F.lit(0.0)) + F.col("score")
    return both.select("node", score.alias("rank_score")).join(names, "node", "left").orderBy(F.desc("rank_score"), "node").limit(k)


def communities_by_type(nodes: DataFrame) -> DataFrame:
    """Each node with its type and that type's size: a row for each member, as a type can hold any number."""
    sizes = nodes.groupBy("type").agg(F.count(F.lit(1)).alias("size"))
    return nodes.join(sizes, "type").select("type", "size", "node")


def communities(edges: DataFrame, least: int) -> DataFrame:
    """Components of at least ``least`` nodes."""
    labels = connected_components(edges)
    big = labels.groupBy("component").agg(F.count(F.lit(1)).alias("size")).filter(F.col("size") >= least)
    return labels.join(big, "component").select("node", "component", "size")


def label_communities(edges: DataFrame, rounds: int = 8) -> DataFrame:
    """Weighted label propagation: each round, every second node takes the label with most weight around it."""
    return _propagated(facing(cut(edges.select("a", "b", "weight"))), rounds)


def _propagated(near: DataFrame, rounds: int = 8) -> DataFrame:
    labels = cut(near.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
    n = labels.count()
    for k in range(rounds):
        votes = near.join(sent(labels.select(F.col("node").alias("b"), "label"), n), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        best = votes.groupBy("node").agg(F.max(F.struct("w", (-F.col("label")).alias("l"))).alias("m")).select("node", (-F.col("m.l")).alias("new"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        labels = cut(labels.join(best, "node").select("node", F.when(turn, F.col("new")).otherwise(F.col("label")).alias("label")))
    return labels


def _moved(near: DataFrame, degrees: DataFrame, labels: DataFrame, total: float, rounds: int) -> DataFrame:
    """Labels after rounds in which every second node takes the neighbouring label that adds most modularity; an own label is kept in ties."""
    n = degrees.count()
    for k in range(rounds):
        known = degrees.join(labels, "node")
        sizes = known.groupBy("label").agg(F.sum("degree").alias("size"))
        votes = near.join(sent(labels.select(F.col("node").alias("b"), "label"), n), "b").groupBy(F.col("a").alias("node"), "label").agg(F.sum("weight").alias("w"))
        votes = votes.unionByName(labels.select("node", "label", F.lit(0.0).alias("w"))).groupBy("node", "label").agg(F.sum("w").alias("w"))
        own = known.select("node", "degree", F.col("label").alias("own"))
        rated = votes.join(own, "node").join(sizes, "label")
        rest = F.col("size") - F.when(F.col("label") == F.col("own"), F.col("degree")).otherwise(F.lit(0.0))
        gain = F.round(F.col("w") - F.col("degree") * rest / total, 9)
        best = rated.groupBy("node", "own").agg(F.max(F.struct(gain.alias("gain"), (F.col("label") == F.col("own")).alias("same"), (-F.col("label")).alias("l"))).alias("m"))
        turn = F.pmod(F.xxhash64("node"), F.lit(2)) == k % 2
        new = cut(best.select("node", F.when(turn, -F.col("m.l")).otherwise(F.col("own")).alias("label")))
        same = k > 0 and new.join(labels, ["node", "label"], "left_anti").isEmpty()
        labels = new
        if same:
            break
    return labels


def louvain_communities(edges: DataFrame, rounds: int = 6, levels: int = 3) -> DataFrame:
    """(node, label): communities by label propagation, then by moves that add modularity, of nodes first and then of whole communities.

    After each level the communities become the nodes of a smaller graph whose edges are the sums between them.
    The labelling with the highest modularity of all levels is returned, so it is never below propagation's.
    """
    edges = cut(edges.select("a", "b", F.col("weight").cast("double").alias("weight")).filter("a <> b"))
    both = facing(edges)
    best = _propagated(both)
    score = modularity(edges, best).first()["modularity"]
    near, degrees = both, both.groupBy(F.col("a").alias("node")).agg(F.sum("weight").alias("degree"))
    total = degrees.agg(F.sum("degree")).first()[0] or 1.0
    labels, owner = best, cut(degrees.select("node", F.col("node").alias("part")))
    for level in range(levels):
        near, degrees = cut(near) if level else near, cut(degrees)  # the first level reads the stored edges
        labels = _moved(near, degrees, labels, total, rounds)
        whole = cut(owner.join(labels.select(F.col("node").alias("part"), "label"), "part").select("node", "label"))
        reached = modularity(edges, whole).first()["modularity"]
        if score is None or reached > score + 1e-12:
            best, score = whole, reached
        names = labels.select("node", "label")
        n = names.count()
        smaller = near.join(sent(names.select(F.col("node").alias("a"), F.col("label").alias("x")), n), "a").join(sent(names.select(F.col("node").alias("b"), F.col("label").alias("y")), n), "b")
        near = smaller.filter("x <> y").groupBy(F.col("x").alias("a"), F.col("y").alias("b")).agg(F.sum("weight").alias("weight"))
        degrees = degrees.join(names, "node").groupBy(F.col("label").alias("node")).agg(F.sum("degree").alias("degree"))
        owner = whole.select("node", F.col("label").alias("part"))
        labels = cut(degrees.select("node", F.col("node").alias("label")))
    return best


def central_nodes(edges: DataFrame, k: int = 5) -> DataFrame:
    """(measure, place, node, score): the ``k`` most central nodes by degree, betweenness and eigenvector, each a ranking of its own."""
    nodes = edges.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    measures = {"degree": degree_centrality(edges).select("node", F.col("centrality").alias("score")), "betweenness": betweenness(edges, nodes).select("node", F.col("betweenness").alias("score")), "eigenvector": eigenvector_centrality(edges).select("node", "score")}
    parts = []
    for name, scores in measures.items():
        top = scores.withColumn("score", F.round("score", 9)).orderBy(F.desc("score"), "node").limit(k)  # k rows
        parts.append(top.select(F.lit(name).alias("measure"), F.row_number().over(Window.orderBy(F.desc("score"), "node")).alias("place"), "node", "score"))
    return reduce(DataFrame.unionByName, parts)


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """Modularity of a labelling of an undirected weighted graph, in one row."""
    la, lb = labels.select(F.col("node").alias("a"), F.col("label").alias("x")), labels.select(F.col("node").alias("b"), F.col("label").alias("y"))
    n = labels.count()
    # Sums between labels, stored; what follows reads only these.
    rows = cut(edges.join(sent(la, n), "a").join(sent(lb, n), "b").groupBy("x", "y").agg(F.sum("weight").alias("weight")))
    total = rows.agg(F.sum("weight").alias("m"))
    inside = rows.filter("x = y").groupBy("x").agg(F.sum("weight").alias("inside"))
    ends = rows.select(F.col("x").alias("label"), "weight").unionByName(rows.select(F.col("y").alias("label"), "weight")).groupBy("label").agg(F.sum("weight").alias("ends"))
    parts = ends.join(inside, ends["label"] == inside["x"], "left").join(F.broadcast(total))
    return parts.agg(F.sum(F.coalesce("inside", F.lit(0)) / F.col("m") - F.pow(F.col("ends") / (2 * F.col("m")), F.lit(2))).alias("modularity"))


def coordinated_campaigns(edges: DataFrame, dates: DataFrame, least_weight: float, least_nodes: int) -> DataFrame:
    """Components over strong edges: size, first date, span in days, density."""
    strong = edges.filter(F.col("weight") >= least_weight)
    labels = cut(connected_components(strong))
    inner = strong.join(labels.select(F.col("node").alias("a"), "component"), "a").groupBy("component").agg(F.count(F.lit(1)).alias("links"))
    facts = labels.join(dates, "node", "left").groupBy("component").agg(F.count_distinct("node").alias("size"), F.min("first_at").alias("first_at"), F.datediff(F.max("last_at"), F.min("first_at")).alias("span_days"))
    n = F.col("size")
    return facts.filter(n >= least_nodes).join(inner, "component").select("component", "size", "first_at", "span_days", (2 * F.col("links") / (n * (n - 1))).alias("density"))


def crawl_frontier(links: DataFrame, starts: DataFrame, max_pages: int, exclude: str | None = None) -> DataFrame:
    """Pages (node) in breadth-first order from the starts, with depth, within the starts' domain; at most ``max_pages`` by depth, then name."""
    allowed = links if exclude is None else links.filter(~F.col("b").rlike(exclude))
    seen = cut(starts.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier, n, d = seen, seen.count(), 0
    new = n
    while n < max_pages:
        d += 1
        # Fewer than ``max_pages`` pages are broadcast where they are few, so that the links aren't shuffled.
        ahead, known = sent(frontier.select(F.col("node").alias("a")), 8 * new), sent(seen.select(F.col("node").alias("b")), 8 * n)
        found = allowed.join(ahead, "a", "left_semi").join(known, "b", "left_anti").select(F.col("b").alias("node")).distinct()
        frontier = cut(found.withColumn("depth", F.lit(d)))
        new = frontier.count()
        if not new:
            break
        n += new
        seen = cut(seen.unionByName(frontier))
    return seen.orderBy("depth", "node").limit(max_pages)
