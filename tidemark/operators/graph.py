"""Graphs as edge tables (a < b, sim): density, clustering, components, paths, centrality, contagion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.medians import medians
from tidemark.session import cut, stored

#: Centrality and spectrum need the whole graph in each task; larger ones are refused.
MOST_EDGES = 2_000_000
#: Nodes that still change their community of which no two neighbours do so at once.
FEW = 32


def both_ways(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("a").alias("u"), F.col("b").alias("v"), "sim").unionAll(edges.select(F.col("b").alias("u"), F.col("a").alias("v"), "sim"))


def density(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    n = nodes.agg(F.count("*").alias("nodes"))
    m = edges.agg(F.count("*").alias("edges"))
    return n.crossJoin(m).select("nodes", "edges", F.round(F.coalesce(F.try_divide(2.0 * F.col("edges"), F.col("nodes") * (F.col("nodes") - 1)), F.lit(0.0)), 9).alias("density"))  # one row each


def degrees(edges: DataFrame) -> DataFrame:
    """(node, degree, strongest, neighbour): how many neighbours a node has and the most similar one."""
    e = both_ways(edges).withColumn("s", F.round("sim", 6))
    return e.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("degree"), F.max("s").alias("strongest"), F.min_by("v", F.struct(-F.col("s"), "v")).alias("neighbour"))


def clustering(edges: DataFrame) -> DataFrame:
    """(node, coefficient): weighted by the geometric mean of a triangle's edges over the largest weight."""
    top = edges.agg(F.max("sim").alias("top"))
    w = edges.crossJoin(top).select("a", "b", (F.col("sim") / F.col("top")).alias("w"))  # one row
    x, y, z = (w.select(F.col("a").alias(p), F.col("b").alias(q), F.col("w").alias(f"w{p}{q}")) for p, q in (("i", "j"), ("j", "k"), ("i", "k")))
    t = x.join(y, "j").join(z, ["i", "k"]).select("i", "j", "k", F.pow(F.col("wij") * F.col("wjk") * F.col("wik"), F.lit(1 / 3)).alias("g"))
    per = t.select(F.explode(F.array("i", "j", "k")).alias("node"), "g").groupBy("node").agg(F.sum("g").alias("g"))
    d = both_ways(edges).groupBy(F.col("u").alias("node")).agg(F.count("*").alias("d"))
    return d.join(per, "node", "left").select("node", F.round(F.coalesce(F.when(F.col("d") > 1, 2 * F.col("g") / (F.col("d") * (F.col("d") - 1))), F.lit(0.0)), 6).alias("coefficient"))


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node each one is connected with.

    Labels fall to the smallest of the neighbourhood and then jump to the label
    of their label, so the number of rounds grows with the logarithm of the
    longest path; each round is cut from the plan before it.
    """
    e = cut(both_ways(edges).select("u", "v"))
    label = cut(nodes.select("node", F.col("node").alias("component")))
    while True:
        near = e.join(label.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("low"))
        fell = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("low", "component")).alias("component"))
        jumped = fell.join(fell.select(F.col("node").alias("component"), F.col("component").alias("next")), "component").select("node", "next")
        new = cut(jumped.withColumnRenamed("next", "component"))
        moved = new.join(label.withColumnRenamed("component", "old"), "node").where("component <> old").limit(1).count()
        label = new
        if not moved:
            return label


def path_lengths(edges: DataFrame) -> DataFrame:
    """(hops, pairs): how many ordered pairs of nodes lie so many hops apart, by breadth-first rounds from every node at once."""
    e = cut(both_ways(edges).select("u", "v"))
    seen = cut(e.select(F.col("u").alias("src")).distinct().select("src", F.col("src").alias("node"), F.lit(0).alias("hops")))
    hop = 0
    while True:
        front = seen.where(F.col("hops") == hop)
        new = front.join(e, front["node"] == e["u"]).select("src", F.col("v").alias("node")).distinct().join(seen.select("src", "node"), ["src", "node"], "left_anti").withColumn("hops", F.lit(hop + 1))
        new = cut(new)
        if not new.limit(1).count():
            return seen.where("hops > 0").groupBy("hops").agg(F.count("*").alias("pairs"))
        seen = cut(seen.unionAll(new))
        hop += 1


def _small(edges: DataFrame) -> list[tuple[int, int, float]]:
    """The edges of a company graph whose size was checked first."""
    if edges.count() > MOST_EDGES:
        raise ValueError(f"more than {MOST_EDGES} edges: centrality is defined for company graphs only")
    return [(r.a, r.b, r.sim) for r in edges.select("a", "b", "sim").collect()]


def betweenness(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, betweenness), normalised; similarities are read as distances, as the measure is defined here.

    Sources are spread over the tasks; each runs shortest paths over the shared
    graph and partial dependencies are summed.
    """
    import heapq

    shared = edges.sparkSession.sparkContext.broadcast(_small(edges))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        near: dict[int, list[tuple[int, float]]] = {}
        for a, b, w in shared.value:
            near.setdefault(a, []).append((b, w))
            near.setdefault(b, []).append((a, w))
        total: dict[int, float] = {}
        for batch in batches:
            for s in batch["node"]:
                dist, sigma, before, order = {s: 0.0}, {s: 1.0}, {s: []}, []
                heap, done = [(0.0, s)], set()
                while heap:
                    d, u = heapq.heappop(heap)
                    if u in done:
                        continue
                    done.add(u)
                    order.append(u)
                    for v, w in near.get(u, ()):
                        nd = d + w
                        if v not in dist or nd < dist[v] - 1e-12:
                            dist[v], sigma[v], before[v] = nd, sigma[u], [u]
                            heapq.heappush(heap, (nd, v))
                        elif abs(nd - dist[v]) <= 1e-12 and v not in done:
                            sigma[v] += sigma[u]
                            before[v].append(u)
                owed = dict.fromkeys(order, 0.0)
                for v in reversed(order):
                    for u in before[v]:
                        owed[u] += sigma[u] / sigma[v] * (1 + owed[v])
                    if v != s:
                        total[v] = total.get(v, 0.0) + owed[v]
        yield pd.DataFrame({"node": list(total), "part": list(total.values())}).astype({"node": "int64", "part": "float64"})

    n = nodes.count()
    parts = nodes.select("node").repartition(8).mapInPandas(run, "node bigint, part double").groupBy("node").agg(F.sum("part").alias("b"))
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    return nodes.select("node").join(parts, "node", "left").select("node", (F.coalesce("b", F.lit(0.0)) * scale).alias("betweenness"))


def ego(edges: DataFrame, share: float = 0.9) -> DataFrame:
    """(node, rank, neighbour, sim, is_hub): each node's neighbours in order of similarity, and whether the node has as many as the best tenth."""
    e = both_ways(edges).withColumn("s", F.round("sim", 6))
    degree = e.groupBy("u").agg(F.count("*").cast("double").alias("d"))
    limit = medians(degree.withColumn("all", F.lit(1)), ["all"], "d", "limit", share).select("limit")
    hub = degree.join(F.broadcast(limit), F.col("d") >= F.col("limit")).select("u", F.lit(True).alias("is_hub"))  # one row
    rank = F.row_number().over(Window.partitionBy("u").orderBy(F.desc("s"), "v"))
    return e.join(hub, "u", "left").select(F.col("u").alias("node"), rank.alias("rank"), F.col("v").alias("neighbour"), F.col("s").alias("sim"), F.coalesce("is_hub", F.lit(False)).alias("is_hub"))


def mean_path_length(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, nodes, mean_hops) of the largest component (of equals that of the smallest node); null for a single node."""
    c = components(nodes, edges)
    top = c.groupBy("component").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "component").limit(1)
    inside = edges.join(c.join(F.broadcast(top), "component").select(F.col("node").alias("a")), "a", "left_semi")  # one row
    hops = path_lengths(inside).agg((F.sum(F.col("hops") * F.col("pairs")) / F.sum("pairs")).alias("m"))
    return top.join(F.broadcast(hops), F.lit(True), "left").select("component", "nodes", F.round("m", 6).alias("mean_hops"))


def contagion_scores(paths: DataFrame, new: DataFrame) -> DataFrame:
    """(company, phrases, matched, score, mean_lag, bridged, first_mover): the share of a company's new phrases that a peer had said before; a company without any is a first mover."""
    total = new.groupBy("company").agg(F.count_distinct("phrase").alias("phrases"))
    m = paths.groupBy("company").agg(F.count("*").alias("matched"), F.avg("lag").alias("mean_lag"), F.count_if(F.col("hops") == 2).alias("bridged"))
    j = total.join(m, "company", "left").withColumn("matched", F.coalesce("matched", F.lit(0)))
    return j.select("company", "phrases", "matched", F.round(F.col("matched") / F.col("phrases"), 6).alias("score"), F.round("mean_lag", 6).alias("mean_lag"), F.coalesce("bridged", F.lit(0)).alias("bridged"), (F.col("matched") == 0).alias("first_mover"))


def hubs(central: DataFrame, share: float = 0.9) -> DataFrame:
    limit = medians(central.withColumn("all", F.lit(1)), ["all"], "betweenness", "limit", share).select("limit")
    return central.join(F.broadcast(limit), F.col("betweenness") >= F.col("limit")).select("node", F.round("betweenness", 9).alias("betweenness"))  # one row


def _second_smallest(n: int, a: np.ndarray, b: np.ndarray, w: np.ndarray, basis: int = 100) -> float:
    """The second smallest eigenvalue of the normalised Laplacian, by Lanczos steps from a sparse graph without isolated nodes.

    The smallest is 0, of the root of the degrees, which is projected out. A
    basis that is full is restarted from its best vector until the residual,
    which bounds the error, is small; without that an error is raised.
    """
    u, v, w2 = np.concatenate([a, b]), np.concatenate([b, a]), np.concatenate([w, w])
    degree = np.bincount(u, w2, n)
    scaled = w2 / np.sqrt(degree[u] * degree[v])
    null = np.sqrt(degree / degree.sum())
    start = np.random.default_rng(7).normal(size=n)
    for _ in range(200):
        start -= null * (null @ start)
        q, alpha, beta = [start / np.linalg.norm(start)], [], []
        while True:
            y = np.bincount(u, scaled * q[-1][v], n)
            alpha.append(float(q[-1] @ y))
            for _ in range(2):
                y -= null * (null @ y)
                known = np.array(q)
                y -= known.T @ (known @ y)
            left = float(np.linalg.norm(y))
            values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta, 1) + np.diag(beta, -1))
            if left * abs(vectors[-1, -1]) < 1e-9 or len(q) == n - 1:
                return float(1 - values[-1])
            if len(q) == basis:
                break
            beta.append(left)
            q.append(y / left)
        start = np.array(q).T @ vectors[:, -1]
    raise ValueError("the spectral gap did not converge")


def spectral_gap(edges: DataFrame, dense: int = 5000) -> float | None:
    """The second smallest less the smallest eigenvalue of the normalised Laplacian; None below three nodes.

    Up to ``dense`` nodes from the whole matrix, beyond by a sparse iteration.
    """
    e = _small(edges)
    ids = sorted({x for a, b, _ in e for x in (a, b)})
    if len(ids) < 3:
        return None
    at = {x: i for i, x in enumerate(ids)}
    if len(ids) > dense:
        return _second_smallest(len(ids), np.array([at[a] for a, _, _ in e]), np.array([at[b] for _, b, _ in e]), np.array([s for _, _, s in e], float))
    w = np.zeros((len(ids), len(ids)))
    for a, b, s in e:
        w[at[a], at[b]] = w[at[b], at[a]] = s
    d = 1 / np.sqrt(w.sum(1))
    values = np.linalg.eigvalsh(np.eye(len(ids)) - d[:, None] * w * d[None])
    return float(values[1] - values[0])


def communities(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, community) by weighted label propagation, run until no node's neighbours have a label of larger total similarity than its own.

    A node takes the label of the largest total similarity, the smaller one of
    equals, but keeps its own where that is among the largest. Half of the nodes
    that would change do so in a round, so neighbours don't just swap. A round
    that does not raise the similarity inside communities is taken back, and
    only such nodes change of which no two are neighbours, which always raises
    it (so do the last few nodes at once): it rises from round to round, so the rounds end. Similarities count in
    billionths, so that sums do not depend on their order.
    """
    e = cut(both_ways(edges).select("u", "v", F.round(F.col("sim") * 1e9).cast("bigint").alias("w")))

    def judged(label: DataFrame) -> DataFrame:
        """(node, community, own, new): similarity to the own label, and the better label, if any."""
        votes = e.join(label.withColumnRenamed("node", "v"), "v").groupBy(F.col("u").alias("node"), F.col("community").alias("theirs")).agg(F.sum("w").alias("w"))
        j = label.join(votes, "node", "left").groupBy("node", "community").agg(
            F.sum(F.when(F.col("theirs") == F.col("community"), F.col("w")).otherwise(0)).alias("own"), F.min_by("theirs", F.struct(-F.col("w"), "theirs")).alias("best"), F.max("w").alias("most")
        )
        # written, for a checkpoint keeps the plan's constraints, which double with every round
        return stored(j.select("node", "community", "own", F.when(F.col("most") > F.col("own"), F.col("best")).alias("new")))

    state = judged(nodes.select("node", F.col("node").alias("community")))
    inside, moving = state.agg(F.coalesce(F.sum("own"), F.lit(0)), F.count("new")).first()
    no = 0
    while moving:
        no += 1
        order = F.xxhash64("node", F.lit(no))
        sums = None
        if moving > FEW:
            half = F.when(order % 2 == 0, F.col("new"))
            then = judged(state.select("node", F.coalesce(half, "community").alias("community")))
            sums = then.agg(F.sum("own"), F.count("new")).first()
        if sums is None or sums[0] <= inside:
            rank = state.where("new is not null").select("node", F.struct(order.alias("h"), "node").alias("o"))
            near = e.join(rank.select(F.col("node").alias("u"), F.col("o").alias("mine")), "u").join(rank.select(F.col("node").alias("v"), F.col("o").alias("theirs")), "v")
            after = near.where("u <> v and theirs > mine").select(F.col("u").alias("node")).distinct()
            free = rank.select("node").join(after, "node", "left_anti").withColumn("free", F.lit(True))
            then = judged(state.join(free, "node", "left").select("node", F.when(F.col("free"), F.col("new")).otherwise(F.col("community")).alias("community")))
            sums = then.agg(F.sum("own"), F.count("new")).first()
        state, inside, moving = then, *sums
    return state.select("node", "community")


def within_two(edges: DataFrame) -> DataFrame:
    """(u, v, hops): neighbours and neighbours of neighbours of each node, without itself."""
    e = both_ways(edges).select("u", "v")
    two = e.join(e.select(F.col("u").alias("v"), F.col("v").alias("x")), "v").where("u <> x").select("u", F.col("x").alias("v"))
    return e.withColumn("hops", F.lit(1)).unionAll(two.withColumn("hops", F.lit(2))).groupBy("u", "v").agg(F.min("hops").alias("hops"))


def contagion(edges: DataFrame, history: DataFrame, new: DataFrame, quarter: int, similarity, least: float = 0.7, reach: int = 4) -> DataFrame:
    """(company, phrase, peer, lag, hops): each new phrase with the first reachable peer that said it in the last ``reach`` quarters.

    ``history`` has (company, quarter, vec), ``new`` (company, phrase, vec);
    peers lie within two hops; of equal lags the smaller peer counts.
    """
    h = history.select(F.col("company").alias("peer"), "quarter", F.col("vec").alias("said")).withColumn("lag", F.lit(quarter) - F.col("quarter")).where(F.col("lag").between(1, reach))
    j = new.join(within_two(edges).select(F.col("u").alias("company"), F.col("v").alias("peer"), "hops"), "company").join(h, "peer")
    j = j.where(F.round(similarity(F.col("vec"), F.col("said")), 9) >= least)
    first = Window.partitionBy("company", "phrase").orderBy("lag", "peer")
    return j.withColumn("r", F.row_number().over(first)).where("r = 1").select("company", "phrase", "peer", "lag", "hops")
