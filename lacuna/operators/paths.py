"""Safety-aware paths: searches inside segments, stored paths between portals, the portal search, stitching and metrics.

Nodes have unique ids; edges to ids without a node lead nowhere. Points of a path are ordered by seq, which is unique in it;
null clearances make a path's sums null. Equal costs go to the path of least ids in rounds, and to the first found in a search.
Nodes of no segment (0 or null) count as one segment without portals.
"""

from __future__ import annotations

import heapq
import math
import uuid
from collections import defaultdict
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.config import DEFAULT, MapConfig
from lacuna.functions.geometry import AXES, linear_safety_cost, unsafety
from lacuna.operators.iterate import cheapest_paths, forget, written

#: Rows of spheres and of edges up to which a task of whole-graph searches holds both: 16 bytes an edge, and a list for each node that a search comes to.
MOST = 2_000_000
#: Searches from which a group of them is divided; a segment's nodes and edges go to each of its groups.
SEARCHES = 4_000
#: Nodes from which a whole-graph search knows the costs to all others, as bounds of what is left of a path.
LANDMARKS = 16
#: The graph that this Python worker has built last, by the name of its map.
_BUILT: dict[str, Graph] = {}


def node_unsafety(r: float, config: MapConfig) -> float:
    return (1 - min((r - config.min_safe) / (config.full_safe - config.min_safe), 1)) ** 2


def node_risk(r: float, config: MapConfig) -> float:
    """What a step to a node of this radius costs beside its length."""
    return config.safety_bias + config.safety_weight * node_unsafety(r, config) if r < config.full_safe else 0.0


class Graph:
    """Positions, radii and neighbours of one group of nodes."""

    def __init__(self, nodes: pd.DataFrame, edges: pd.DataFrame):
        self.at = {int(i): (x, y, z) for i, x, y, z in zip(nodes.id, nodes.x, nodes.y, nodes.z, strict=True)}
        self.radius = dict(zip(map(int, nodes.id), nodes.radius, strict=True))
        src, dst, ids = edges.src.to_numpy(np.int64), edges.dst.to_numpy(np.int64), nodes.id.to_numpy(np.int64)
        known = np.isin(src, ids) & np.isin(dst, ids)
        src, dst = src[known], dst[known]
        order = np.lexsort((dst, src))
        self.src, self.dst = src[order], dst[order]
        self.ways: dict[MapConfig, dict[int, list[tuple[int, float]]]] = {}
        self.parts: dict[int, int] | None = None
        self.steps: dict[MapConfig, tuple] = {}
        self.marks: dict[MapConfig, tuple | None] = {}
        self.left: tuple[int, MapConfig, Callable[[int], float]] | None = None

    def out(self, a: int, config: MapConfig) -> list[tuple[int, float]]:
        """Neighbours in order of key, and what a step to each costs."""
        ways = self.ways.setdefault(config, {})
        if a not in ways:
            low, high = np.searchsorted(self.src, (a, a + 1))
            ways[a] = [(b, self.step(a, b, config)) for b in self.dst[low:high].tolist()]
        return ways[a]

    def connected(self, a: int, b: int) -> bool:
        """Whether edges, taken in both directions, lead from a to b; without that there is no path."""
        if self.parts is None:
            up = {n: n for n in self.at}

            def top(n: int) -> int:
                while up[n] != n:
                    up[n] = n = up[up[n]]
                return n

            for x, y in zip(self.src.tolist(), self.dst.tolist(), strict=True):
                x, y = top(x), top(y)
                if x != y:
                    up[max(x, y)] = min(x, y)
            self.parts = {n: top(n) for n in up}
        return a in self.parts and self.parts.get(a) == self.parts.get(b)

    def two_way(self) -> bool:
        """Whether every edge leads both ways; then a path leads wherever nodes are connected."""
        back = np.lexsort((self.src, self.dst))
        return np.array_equal(self.dst[back], self.src) and np.array_equal(self.src[back], self.dst)

    def costs(self, start: int, config: MapConfig) -> dict[int, float]:
        """Least costs from a node to all that it reaches."""
        return {n: g for n, g in zip(self.at, self.all_costs(start, config).tolist(), strict=True) if g < math.inf}

    def all_costs(self, start: int, config: MapConfig) -> np.ndarray:
        """Least costs from a node to all nodes, in their order; infinite to those it does not reach.

        All edges from the nodes that improved are relaxed at once, until none improves; the sums are those of a search."""
        if config not in self.steps:
            place = {n: i for i, n in enumerate(self.at)}
            src, dst = (np.array([place[n] for n in x.tolist()], dtype=np.int64) for x in (self.src, self.dst))
            cost = np.array([self.step(a, b, config) for a, b in zip(self.src.tolist(), self.dst.tolist(), strict=True)])
            order = np.argsort(dst, kind="stable")
            src, dst, cost = src[order], dst[order], cost[order]
            self.steps[config] = place, src, cost, np.flatnonzero(np.diff(dst, prepend=-1)), dst
        place, src, cost, first, dst = self.steps[config]
        best = np.full(len(self.at), np.inf)
        best[place[start]] = 0.0
        while len(first):
            new = np.minimum(best[dst[first]], np.minimum.reduceat(best[src] + cost, first))
            if np.array_equal(new, best[dst[first]]):
                break
            best[dst[first]] = new
        return best

    def bounds(self, goal: int, config: MapConfig) -> Callable[[int], float] | None:
        """Lower bounds of the cost to the goal, from the costs of LANDMARKS nodes; None where an edge leads one way only.

        A step costs its length and the risk of its end. With half the risk of both ends it costs the same in both directions, and
        the costs of two nodes from a landmark differ by no more than the cost between them.
        """
        if config not in self.marks:
            if not self.at or not self.two_way():
                self.marks[config] = None
            else:
                place = {n: i for i, n in enumerate(self.at)}
                half = np.array([node_risk(self.radius[n], config) / 2 for n in self.at])
                ids, rows, least = list(self.at), [], np.full(len(self.at), np.inf)
                degree = np.bincount([place[n] for n in self.src.tolist()], minlength=len(ids))
                one = ids[int(degree.argmax())]
                for _ in range(LANDMARKS):
                    row = self.all_costs(one, config)
                    row[np.isinf(row)] = np.nan
                    row += half[place[one]] - half
                    rows.append(np.nan_to_num(row, nan=0.0))  # in another part no bound: 0 for a node and for its goal
                    least = np.fmin(least, row)
                    one = ids[int(np.where(np.isfinite(least), least, -1).argmax())]
                self.marks[config] = place, np.array(rows), half, np.array(list(self.at.values()))
        if self.marks[config] is None:
            return None
        if self.left is None or self.left[:2] != (goal, config):  # requests with equal goals come one after another
            place, rows, half, points = self.marks[config]
            at = place[goal]
            left = np.abs(rows - rows[:, at : at + 1]).max(axis=0) - half + half[at]
            line = np.sqrt(np.square(points - points[at]).sum(axis=1))
            self.left = goal, config, dict(zip(self.at, np.fmax(left, line).tolist(), strict=True)).__getitem__
        return self.left[2]

    def step(self, a: int, b: int, config: MapConfig) -> float:
        return math.dist(self.at[a], self.at[b]) + node_risk(self.radius[b], config)

    def search(self, start: int, goal: int, config: MapConfig, exact: bool = True, heuristic: Callable[[int], float] | None = None, is_goal: Callable[[int], bool] | None = None) -> list[int] | None:
        """Nodes of a least-cost path to the goal, or to the first node that is_goal accepts (a node of some segment, say).

        heuristic: least cost that is left from a node, by default the straight distance to the goal; it must not be too high.
        exact=False closes a node when it is first reached and ends when the goal is, as the
        compatible mode does, so its path need not be the cheapest; neighbours are taken in order of key."""
        if start not in self.at or goal not in self.at:
            return None
        if is_goal is not None and heuristic is None:
            heuristic = lambda _: 0.0
        rest = heuristic or (lambda n: math.dist(self.at[n], self.at[goal]))
        reached = is_goal or (lambda n: n == goal)
        if reached(start):
            return [start, start]
        queue, cost, parent, done = [(rest(start), 0.0, start)], {start: 0.0}, {start: None}, set()
        end = None
        while queue:
            _, g, node = heapq.heappop(queue)
            if exact and reached(node):
                end = node
                break
            if node in done:
                continue
            done.add(node)
            for n, w in self.out(node, config):
                new = g + w
                if n in cost and (not exact or cost[n] <= new):
                    continue
                cost[n], parent[n] = new, node
                if not exact and reached(n):
                    queue, end = [], n
                    break
                heapq.heappush(queue, (new + rest(n), new, n))
        if end is None:
            return None
        out = [end]
        while parent[out[-1]] is not None:
            out.append(parent[out[-1]])
        return out[::-1]

    def summary(self, path: list[int], config: MapConfig) -> tuple[float, float, float]:
        """Length, unsafety of all nodes but the first, least radius."""
        length = sum(math.dist(self.at[a], self.at[b]) for a, b in zip(path, path[1:], strict=False))
        return length, sum(node_unsafety(self.radius[n], config) for n in path[1:]), min(self.radius[n] for n in path)

    def cost(self, path: list[int], config: MapConfig) -> float:
        return sum(self.step(a, b, config) for a, b in zip(path, path[1:], strict=False) if a != b)


STORED = "seg int, nb1 int, nb2 int, path array<long>, length double, total_unsafety double, min_safedist double, cost double"


def stored_paths(safe: DataFrame, edges: DataFrame, connection: DataFrame, config: MapConfig = DEFAULT, exact: bool = True) -> DataFrame:
    """For each segment and pair of its neighbours (nb1 < nb2) the path between its own ends of the two connections.

    A segment's nodes, at most a few thousand by the growth radius, are one group of a cogrouped search.
    """
    own = connection.select("seg", "other", "own_key")
    ends = own.alias("a").join(own.alias("b"), (F.col("a.seg") == F.col("b.seg")) & (F.col("a.other") < F.col("b.other"))).select(F.col("a.seg").alias("seg"), F.col("a.other").alias("nb1"), F.col("b.other").alias("nb2"), F.col("a.own_key").alias("k1"), F.col("b.own_key").alias("k2"))
    nodes = safe.select(F.col("segment_id").alias("seg"), F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "x", "y", "z", "radius", F.lit(0).alias("nb1"), F.lit(0).alias("nb2"))
    nil = F.lit(0.0)
    inner = edges.where("s1 = s2").select(F.col("s1").alias("seg"), F.lit(1).alias("kind"), F.col("src").alias("a"), F.col("dst").alias("b"), nil.alias("x"), nil.alias("y"), nil.alias("z"), nil.alias("radius"), F.lit(0).alias("nb1"), F.lit(0).alias("nb2"))
    asks = ends.select("seg", F.lit(2).alias("kind"), F.col("k1").alias("a"), F.col("k2").alias("b"), nil.alias("x"), nil.alias("y"), nil.alias("z"), nil.alias("radius"), F.col("nb1").cast("int"), F.col("nb2").cast("int"))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, e, q = (rows[rows.kind == k] for k in range(3))
        graph = Graph(n.rename(columns={"a": "id"}), e.rename(columns={"a": "src", "b": "dst"}))
        out = []
        for seg, a, b, nb1, nb2 in zip(q.seg, q.a, q.b, q.nb1, q.nb2, strict=True):
            path = graph.search(int(a), int(b), config, exact)
            if path:
                out.append((seg, nb1, nb2, path, *graph.summary(path, config), graph.cost(path, config)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in STORED.split(", ")])

    return nodes.unionByName(inner).unionByName(asks).groupBy("seg").applyInPandas(solve, STORED)


def plan_paths(requests: DataFrame, safe: DataFrame, edges: DataFrame, connection: DataFrame, stored: DataFrame, config: MapConfig = DEFAULT, use_stored: bool = True, exact: bool = False) -> DataFrame:
    """query_id, goal_id, success, message, path (node ids), length, cost for requests(query_id, goal_id, sx..gz).

    The start snaps to the nearest sphere; the goal tries the nearest sphere of each segment in order of distance. With stored
    paths the search is over portals: a path is the start leg, stored legs and a goal leg, by the same searches whatever the
    map's size. Requests without a sphere near start or goal, or with null coordinates, do not succeed; repeated requests are
    answered each.
    """
    from lacuna.operators.graph import nearest_node, nearest_per_segment

    start = nearest_node(requests.select("query_id", "goal_id", F.struct("query_id", "goal_id").alias("pid"), F.col("sx").alias("x"), F.col("sy").alias("y"), F.col("sz").alias("z")), safe, config.snap_distance, config=config)
    goal = nearest_per_segment(requests.select(F.struct("query_id", "goal_id").alias("pid"), F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("z")), safe, config.snap_distance, config=config)
    goals = goal.groupBy("pid").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("goals"))  # at most one a segment in reach
    asked = requests.select("query_id", "goal_id", F.struct("query_id", "goal_id").alias("pid")).join(start.select("pid", F.col("id").alias("start")), "pid", "left").join(goals, "pid", "left")
    asked = asked.select("query_id", "goal_id", "start", F.coalesce(F.col("goals.id"), F.array().cast("array<long>")).alias("goals"))
    if not use_stored and max(t.limit(MOST + 1).count() for t in (safe, edges)) > MOST:
        if not exact:
            raise ValueError(f"compatible whole-graph searches need maps of at most {MOST:,} spheres and edges; ask for exact ones")
        return _plan_by_rounds(asked, safe, edges, config)
    # A search for each start and list of goals.
    asked = written(asked)
    asks = asked.where("start is not null").select("start", "goals").distinct()
    found = _by_portals(asks, safe, edges, connection, stored, config) if use_stored else _by_whole_graph(asks, safe, edges, config, exact)
    done = asked.join(found, ["start", "goals"], "left")
    good = F.col("path").isNotNull()
    return done.select("query_id", "goal_id", good.alias("success"), F.when(good, "success!").otherwise("could not find path!").alias("message"), "path", "length", "cost")


def _by_whole_graph(asks: DataFrame, safe: DataFrame, edges: DataFrame, config: MapConfig, exact: bool) -> DataFrame:
    """(start, goals, path, length, cost) of paths without a look at segments; every task holds the graph."""
    spark = asks.sparkSession
    tables = spark.sparkContext.broadcast((safe.select("id", "x", "y", "z", "radius").toPandas(), edges.select("src", "dst").toPandas()))
    name, schema = uuid.uuid4().hex, "start long, goals array<long>, path array<long>, length double, cost double"

    def run(batches):
        graph = _graph(name, tables)
        for batch in batches:
            out = []
            for s, goals in zip(batch.start, batch.goals, strict=True):
                for end in goals:
                    path = graph.search(int(s), int(end), config, exact, graph.bounds(int(end), config) if exact else None) if graph.connected(int(s), int(end)) else None
                    if path:
                        out.append((s, goals, path, graph.summary(path, config)[0], graph.cost(path, config)))
                        break
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    # Tasks as many as cores, whatever few bytes the requests are; bounds are for a goal.
    asks = asks.repartitionByRange(4 * spark.sparkContext.defaultParallelism, "goals", "start").sortWithinPartitions("goals", "start")
    return written(asks.mapInPandas(run, schema))


def _graph(name: str, tables) -> Graph:
    """The graph of a broadcast map, built once in each Python worker."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Graph(*tables.value)
    return _BUILT[name]


def _by_portals(asks: DataFrame, safe: DataFrame, edges: DataFrame, connection: DataFrame, stored: DataFrame, config: MapConfig) -> DataFrame:
    """(start, goals, path, length, cost) of portal searches: all try their nearest goal, then those that failed all others."""
    whole = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0).cast("long"))
    nodes = safe.select("id", whole("segment_id").alias("seg"), *AXES, "radius")
    inner = edges.where(whole("s1") == whole("s2")).select(whole("s1").alias("seg"), "src", "dst")
    place = lambda key, p: nodes.select(F.col("id").alias(key), *(F.col(c).alias(f"{p}{c}") for c in AXES))
    links = connection.select(F.col("seg").cast("long"), F.col("other").cast("long"), F.col("own_key").alias("own"), F.col("other_key").alias("far"))
    links = written(links.join(place("own", "o"), "own").join(place("far", "f"), "far"))
    legs = stored.select(F.col("seg").cast("long"), F.col("nb1").cast("long"), F.col("nb2").cast("long"), "path", "total_unsafety", "min_safedist")
    tried = written(asks.select("start", "goals", F.posexplode("goals").alias("rank", "goal")))
    first = tried.where("rank = 0")
    hit = written(first.join(_portal_paths(first.select("start", "goal").distinct(), nodes, inner, links, legs, config), ["start", "goal"]).select("start", "goals", "path", "length", "cost"))
    rest = written(tried.where("rank > 0").join(hit.select("start", "goals"), ["start", "goals"], "left_anti"))
    if rest.isEmpty():
        return hit
    late = rest.join(_portal_paths(rest.select("start", "goal").distinct(), nodes, inner, links, legs, config), ["start", "goal"])
    late = late.groupBy("start", "goals").agg(F.min_by(F.struct("path", "length", "cost"), "rank").alias("b")).select("start", "goals", "b.*")
    return hit.unionByName(written(late))


def _portal_paths(pairs: DataFrame, nodes: DataFrame, inner: DataFrame, links: DataFrame, legs: DataFrame, config: MapConfig) -> DataFrame:
    """(start, goal, path, length, cost) of the pairs(start, goal) that a path inside their segment or through portals joins."""
    asks = pairs.join(nodes.select(F.col("id").alias("start"), F.col("seg").alias("s")), "start")
    asks = written(asks.join(nodes.select(F.col("id").alias("goal"), F.col("seg").alias("t"), *(F.col(c).alias(f"g{c}") for c in AXES)), "goal"))
    far = asks.where("s <> t")
    own = far.select("s", "start").distinct().join(links.select(F.col("seg").alias("s"), F.col("other").alias("nb"), "own"), "s")
    ends = far.select("t", "goal").distinct().join(links.select(F.col("other").alias("t"), F.col("far").alias("end")), "t")
    ask = lambda df, seg, a, b, path: df.select(F.col(seg).alias("seg"), F.col(a).alias("a"), F.col(b).alias("b"), F.lit(path).alias("whole"))
    inside = ask(asks.where("s = t"), "s", "start", "goal", True).union(ask(own, "s", "start", "own", True)).union(ask(ends, "t", "end", "goal", False))
    inside = written(_inner_paths(inside.distinct(), nodes, inner, config))
    ways = lambda s, a, b: inside.where("whole").select(F.col("seg").alias(s), F.col("a").alias(a), F.col("b").alias(b), "path", "cost")
    begin = own.join(ways("s", "start", "own"), ["s", "start", "own"]).groupBy("start").agg(F.collect_list(F.struct("nb", "own", "cost")).alias("b"))
    close = inside.where("not whole").groupBy(F.col("b").alias("goal")).agg(F.collect_set("a").alias("ends"))
    routes = _portal_routes(far.join(begin.select("start", "b.nb", "b.own", "b.cost"), "start").join(close, "goal"), links, legs, config)
    last = _inner_paths(ask(routes, "t", "end", "goal", True).distinct(), nodes, inner, config).select(F.col("seg").alias("t"), F.col("a").alias("end"), F.col("b").alias("goal"), "path")
    hop = lambda i: F.get("hops", F.col("pos") + i)
    through = routes.where("size(hops) > 2").select("start", "goal", "hops", F.explode(F.sequence(F.lit(1), F.size("hops") - 2)).alias("pos")).select("start", "goal", "pos", hop(0).alias("seg"), F.least(hop(-1), hop(1)).alias("nb1"), F.greatest(hop(-1), hop(1)).alias("nb2"), (hop(-1) > hop(1)).alias("back"))
    through = through.join(legs, ["seg", "nb1", "nb2"]).select("start", "goal", "pos", F.when(F.col("back"), F.reverse("path")).otherwise(F.col("path")).alias("path"))
    parts = routes.join(ways("s", "start", "own"), ["s", "start", "own"]).select("start", "goal", F.lit(0).alias("pos"), "path").union(through)
    parts = parts.union(routes.join(last, ["t", "end", "goal"]).select("start", "goal", F.size("hops").alias("pos"), "path"))
    joined = parts.groupBy("start", "goal").agg(F.flatten(F.array_sort(F.collect_list(F.struct("pos", "path"))).path).alias("path"))
    joined = joined.select("start", "goal", F.filter("path", lambda n, i: (i == 0) | (n != F.get("path", i - 1))).alias("path"))  # a leg begins where one ended
    return _measured(joined.union(asks.where("s = t").join(ways("s", "start", "goal"), ["s", "start", "goal"]).select("start", "goal", "path")), nodes, config)


def _inner_paths(asks: DataFrame, nodes: DataFrame, inner: DataFrame, config: MapConfig) -> DataFrame:
    """(seg, a, b, whole, path, cost) of the asks(seg, a, b, whole) between whose ends a path inside the segment leads; only with `whole` it is searched for.

    The compatible search. A segment's nodes are a group, as in stored_paths; one of many asks has several, each of as many asks as it has nodes or more.
    """
    size = asks.groupBy("seg").agg(F.count("*").alias("n")).join(nodes.groupBy("seg").agg(F.count("*").alias("m")), "seg")
    size = size.select("seg", F.ceil(F.col("n") / F.greatest("m", F.lit(SEARCHES))).cast("int").alias("of"))
    zero, nil = F.lit(0).cast("long"), F.lit(0.0)
    held = nodes.select("seg", F.lit(0).alias("kind"), F.col("id").alias("a"), zero.alias("b"), *AXES, "radius", F.lit(False).alias("whole"))
    held = held.union(inner.select("seg", F.lit(1), "src", "dst", nil, nil, nil, nil, F.lit(False)))
    held = held.join(size, "seg").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("of") - 1)))
    own = asks.select("seg", F.lit(2).alias("kind"), "a", "b", *(nil.alias(c) for c in AXES), nil.alias("radius"), "whole").join(size, "seg").withColumn("part", F.pmod(F.xxhash64("a", "b"), F.col("of")).cast("int"))
    schema = "seg long, a long, b long, whole boolean, path array<long>, cost double"

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        n, e, q = (rows[rows.kind == k] for k in range(3))
        graph = Graph(n.rename(columns={"a": "id"}), e.rename(columns={"a": "src", "b": "dst"}))
        both, out = graph.two_way(), []
        for seg, a, b, whole in zip(q.seg, map(int, q.a), map(int, q.b), q.whole, strict=True):
            if graph.connected(a, b):
                path = graph.search(a, b, config, exact=False) if whole or not both else None
                if path or (both and not whole):
                    out.append((seg, a, b, whole, path if whole else None, graph.cost(path, config) if whole else None))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return held.union(own).repartition(4 * asks.sparkSession.sparkContext.defaultParallelism, "seg", "part").groupBy("seg", "part").applyInPandas(solve, schema)


def portal_route(s: int, t: int, goal: tuple, first: list[tuple[int, float]], ends: set[int], known: set[int], links: dict, legs: dict, config: MapConfig) -> tuple[list[int] | None, set[int]]:
    """The segments of the path that the portal search finds from s to t, and the segments without which that is not sure.

    first: (neighbour, cost) of the legs from the start; ends: far ends of portals to t from which a leg leads to the goal; links:
    for each known segment and neighbour the positions of both ends and the far one's id; legs: (unsafety, least radius) by
    (segment, least and greatest neighbour). Behind an unknown segment it searches on as if that were closed, so as to name more of them.
    """
    queue, parent, seen, missing = [], {}, set(), set()

    def push(g, seg, nb, before):
        heapq.heappush(queue, (g + math.dist(links[seg][nb][1], goal), g, (seg, nb)))
        parent.setdefault((seg, nb), before)

    for nb, cost in first:
        push(cost, s, nb, None)
    while queue:
        _, g, (seg, nb) = heapq.heappop(queue)
        if (min(seg, nb), max(seg, nb)) in seen:
            continue
        seen.add((min(seg, nb), max(seg, nb)))
        if nb == t:
            if links[seg][nb][2] not in ends:
                continue
            hops, state = [t], (seg, nb)
            while state:
                hops.append(state[0])
                state = parent[state]
            return (None if missing else hops[::-1]), missing
        if nb not in known:
            missing.add(nb)
            continue
        for onward, (own, *_) in sorted(links.get(nb, {}).items()):
            leg = legs.get((nb, min(seg, onward), max(seg, onward))) if onward != seg else None
            if leg and (nb, onward) not in parent:
                risk = config.safety_bias + config.safety_weight * leg[0] if leg[1] < config.full_safe else 0.0
                push(g + math.dist(links[seg][nb][1], own) + risk, nb, onward, (seg, nb))
    return None, missing


def _portal_routes(asks: DataFrame, links: DataFrame, legs: DataFrame, config: MapConfig) -> DataFrame:
    """(start, goal, s, t, hops, own, end): segments of the paths of asks(start, goal, s, t, gx, gy, gz, nb, own, cost, ends).

    Groups of asks, those of a start segment together but where they are many, hold the portals and legs of the segments around
    their starts. A search that comes to others names them; in the next round its group has these and those near them too, until
    no search lacks any. The groups are few (four a core, more for many asks), as a failing search may come to all segments.
    """
    tasks = 4 * asks.sparkSession.sparkContext.defaultParallelism
    size = asks.groupBy("s").agg(F.ceil(F.count("*") / SEARCHES).alias("of"))
    left = written(asks.join(size, "s").withColumn("part", F.xxhash64("s", F.pmod(F.xxhash64("start"), F.col("of")))).drop("of"))
    left = left.withColumn("part", F.pmod("part", F.lit(max(tasks, left.count() // (10 * SEARCHES))).cast("long")))
    near, known, found = links.select("seg", "other"), None, []
    want = left.select("part", F.col("s").alias("seg")).distinct()
    zero, nil = F.lit(0).cast("long"), F.lit(0.0)
    schema = "start long, goal long, s long, t long, part long, hops array<long>, own long, end long, missing array<long>"

    def solve(asks: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        known, links, legs, out = set(held.seg[held.kind == 0].tolist()), defaultdict(dict), {}, []
        for kind, seg, n1, n2, ox, oy, oz, fx, fy, fz in zip(*(held[c].tolist() for c in ("kind", "seg", "n1", "n2", "ox", "oy", "oz", "fx", "fy", "fz")), strict=True):
            if kind == 1:
                links[seg][n1] = (ox, oy, oz), (fx, fy, fz), n2
            elif kind == 2:
                legs[seg, n1, n2] = ox, oy
        for start, goal, s, t, part, gx, gy, gz, nb, own, cost, ends in zip(*(asks[c].tolist() for c in ("start", "goal", "s", "t", "part", "gx", "gy", "gz", "nb", "own", "cost", "ends")), strict=True):
            nb, own = [int(n) for n in nb], [int(n) for n in own]
            hops, missing = portal_route(s, t, (gx, gy, gz), list(zip(nb, map(float, cost), strict=True)), set(map(int, ends)), known, links, legs, config)
            out.append((start, goal, s, t, part, hops, hops and own[nb.index(hops[1])], hops and links[hops[-2]][t][2], sorted(missing)))
        return pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")]).astype({"own": "Int64", "end": "Int64"})

    while True:
        want = want.union(want.join(near, "seg").select("part", F.col("other").alias("seg"))).distinct()
        fresh = written(want if known is None else known.union(want).distinct())
        held = fresh.select("part", "seg", F.lit(0).alias("kind"), zero.alias("n1"), zero.alias("n2"), *(nil.alias(f"{p}{c}") for p in "of" for c in AXES))
        held = held.union(fresh.join(links, "seg").select("part", "seg", F.lit(1), "other", "far", *(f"{p}{c}" for p in "of" for c in AXES)))
        held = held.union(fresh.join(legs, "seg").select("part", "seg", F.lit(2), "nb1", "nb2", "total_unsafety", "min_safedist", nil, nil, nil, nil))
        out = written(left.repartition(tasks, "part").groupBy("part").cogroup(held.repartition(tasks, "part").groupBy("part")).applyInPandas(solve, schema))
        found.append(out.where("hops is not null").select("start", "goal", "s", "t", "hops", "own", "end"))
        lack = out.where("size(missing) > 0")
        if lack.isEmpty():
            return reduce(DataFrame.union, found)
        left = written(left.join(lack.select("start", "goal"), ["start", "goal"], "left_semi"))
        known = written(fresh.join(left.select("part").distinct(), "part", "left_semi"))
        forget(fresh)
        want = lack.select("part", F.explode("missing").alias("seg")).distinct()


def _measured(ways: DataFrame, nodes: DataFrame, config: MapConfig) -> DataFrame:
    """(start, goal, path, length, cost) of ways(start, goal, path), the steps summed in their order."""
    points = ways.select("start", "goal", F.posexplode("path").alias("pos", "id")).join(nodes, "id")
    points = points.groupBy("start", "goal").agg(F.array_sort(F.collect_list(F.struct("pos", "id", *AXES, "radius"))).alias("p")).select("start", "goal", "p.id", *(f"p.{c}" for c in (*AXES, "radius")))
    schema = "start long, goal long, path array<long>, length double, cost double"

    def run(batches):
        for batch in batches:
            out = []
            for start, goal, *lists in zip(*(batch[c] for c in ("start", "goal", "id", *AXES, "radius")), strict=True):
                path, x, y, z, radius = (c.tolist() for c in lists)  # Python's sum is exact for its own floats only
                at = list(zip(x, y, z, strict=True))
                steps = [math.dist(a, b) for a, b in zip(at, at[1:], strict=False)]
                cost = sum(d + node_risk(r, config) for d, r, a, b in zip(steps, radius[1:], path, path[1:], strict=False) if a != b)
                out.append((start, goal, path, sum(steps), cost))
            yield pd.DataFrame(out, columns=[c.split()[0] for c in schema.split(", ")])

    return points.mapInPandas(run, schema)


def _plan_by_rounds(asked: DataFrame, safe: DataFrame, edges: DataFrame, config: MapConfig) -> DataFrame:
    """The same answers as of exact whole-graph searches, for maps that no task can hold: cheapest paths over the whole graph, by relaxation of joined tables."""
    size = safe.select("id", *AXES, "radius")
    step = edges.select("src", "dst").join(size.withColumnsRenamed({"id": "src", "x": "x1", "y": "y1", "z": "z1"}).drop("radius"), "src").join(size.withColumnRenamed("id", "dst"), "dst")
    length = F.sqrt(sum(((F.col(f"{c}1") - F.col(c)) * (F.col(f"{c}1") - F.col(c)) for c in AXES), F.lit(0.0)))
    risk = F.when(F.col("radius") < config.full_safe, config.safety_bias + config.safety_weight * unsafety("radius", config)).otherwise(0.0)
    costs = step.select("src", "dst", (length + risk).alias("w"))
    found = cheapest_paths(asked.where("start is not null").select(F.struct("query_id", "goal_id").alias("q"), F.col("start").alias("id")), costs)
    ends = asked.select(F.struct("query_id", "goal_id").alias("q"), F.posexplode("goals").alias("rank", "id"))
    twice = F.when(F.size("path") == 1, F.concat("path", "path")).otherwise(F.col("path")).alias("path")  # start and goal at one sphere
    best = ends.join(found.select("q", "id", "cost", twice), ["q", "id"]).groupBy("q").agg(F.min(F.struct("rank", "cost", "path")).alias("b"))
    points = best.select("q", F.posexplode("b.path").alias("pos", "id")).join(size, "id")
    before = Window.partitionBy("q").orderBy("pos")
    leg = F.sqrt(sum(((F.col(c) - F.lag(c).over(before)) * (F.col(c) - F.lag(c).over(before)) for c in AXES), F.lit(0.0)))
    lengths = points.withColumn("leg", F.coalesce(leg, F.lit(0.0))).groupBy("q").agg(F.sum("leg").alias("length"))
    done = asked.select("query_id", "goal_id", F.struct("query_id", "goal_id").alias("q")).join(best, "q", "left").join(lengths, "q", "left")
    good = F.col("b").isNotNull()
    return done.select("query_id", "goal_id", good.alias("success"), F.when(good, "success!").otherwise("could not find path!").alias("message"), F.col("b.path").alias("path"), "length", F.col("b.cost").alias("cost"))


def metrics(points: DataFrame, config: MapConfig = DEFAULT, base: float = 1.6) -> DataFrame:
    """Length, unsafety (without the first point), least distance and linear cost of paths in long form (path_id, seq, x, y, z, odist)."""
    w = Window.partitionBy("path_id").orderBy("seq")
    step = F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in ("x", "y", "z")), F.lit(0.0)))
    rows = points.withColumns({"step": F.coalesce(step, F.lit(0.0)), "first": F.lag("seq").over(w).isNull()})
    return rows.groupBy("path_id").agg(F.count("*").alias("n"), F.sum("step").alias("length"), F.sum(F.when(F.col("first"), 0.0).otherwise(unsafety("odist", config))).alias("total_unsafety"), F.min("odist").alias("min_odist"), F.sum(linear_safety_cost("odist", config.min_safe, base)).alias("linear_cost"))


def traversable(points: DataFrame, safe: float, ignore: float = 3.0, cutoff: float = math.inf) -> DataFrame:
    """Whether all points, but those within `ignore` metres of either end or beyond the cutoff, are at least `safe` from obstacles."""
    w = Window.partitionBy("path_id").orderBy("seq")
    step = F.coalesce(F.sqrt(sum(((F.col(c) - F.lag(c).over(w)) * (F.col(c) - F.lag(c).over(w)) for c in ("x", "y", "z")), F.lit(0.0))), F.lit(0.0))
    rows = points.withColumn("step", step).withColumn("run", F.sum("step").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("total", F.sum("step").over(Window.partitionBy("path_id")))
    counts = (F.col("run") > ignore) & (F.col("run") < F.col("total") - ignore) & (F.col("run") <= cutoff)
    return rows.groupBy("path_id").agg(F.bool_and(~counts | (F.col("odist") >= safe)).alias("traversable"))
