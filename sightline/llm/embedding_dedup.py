"""Exact near-duplicate links of embeddings by dual traversal of cover trees."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, connected_components, small, table

#: Pivots that space is first divided by: one for so many vectors, and no more than the bound. They only steer the work.
VECTORS_A_PIVOT, MOST_PIVOTS = 1024, 16_384
#: Vectors of a cell, and of its visitors, in one task; larger ones are split over tasks.
CELL, VISITORS = 4096, 8192
#: Candidates for a node's centres that are compared at once; points of a tree's leaf, distances and cosines computed at once, and room for rounding in the bounds.
CENTERS, LEAF, GAPS, ROUNDING = 64, 32, 2_000_000, 1e-7


class CoverTree:
    """Nested levels of centres over points on the unit sphere: each level halves the radius that its centres cover.

    Arrays by node: centre (a point), radius (the farthest of its points, as measured), first child and number of children (none:
    a leaf), and the range of `order` that holds its points.
    """

    def __init__(self, points: np.ndarray):
        self.points, self.order = points, np.arange(len(points))
        self.center, self.radius, self.low, self.high, self.child, self.children = [], [], [], [], [], []
        self._node(0, len(points))
        todo = [(0, 2.0)]
        while todo:
            node, reach = todo.pop()
            low, high = self.low[node], self.high[node]
            if high - low <= LEAF or self.radius[node] <= 1e-9:
                continue
            reach = min(reach, self.radius[node]) / 2
            rest, parts = self.order[low:high], []
            while len(rest):  # each point goes to the first centre in reach; candidates for centres are compared many at once
                ahead = min(CENTERS, len(rest))
                near = _distances(points[rest[:ahead]], points[rest]) <= reach
                near[np.arange(ahead), np.arange(ahead)] = True
                centers, free = [], np.ones(ahead, bool)
                for i in range(ahead):
                    if free[i]:
                        centers.append(i)
                        free &= ~near[i, :ahead]
                near = near[centers]
                first = np.where(near.any(0), near.argmax(0), -1)
                order = np.argsort(first, kind="stable")
                bounds = np.searchsorted(first[order], np.arange(len(centers) + 1))
                parts += [rest[order[a:b]] for a, b in zip(bounds, bounds[1:], strict=False)]
                rest = rest[first < 0]
            self.order[low:high] = np.concatenate(parts)
            self.child[node], self.children[node] = len(self.center), len(parts)
            for part in parts:
                todo.append((len(self.center), reach))
                self._node(low, low + len(part))
                low += len(part)
        for name in ("center", "radius", "low", "high", "child", "children"):
            setattr(self, name, np.array(getattr(self, name)))

    def _node(self, low: int, high: int) -> None:
        own = self.order[low:high]
        self.center.append(own[0] if len(own) else 0)
        self.radius.append(float(_distances(self.points[own[:1]], self.points[own]).max()) if len(own) > 1 else 0.0)
        self.low.append(low)
        self.high.append(high)
        self.child.append(-1)
        self.children.append(0)

    def within(self, node: int) -> np.ndarray:
        return self.order[self.low[node] : self.high[node]]

    def below(self, node: int) -> np.ndarray:
        return np.arange(self.child[node], self.child[node] + self.children[node]) if self.children[node] else np.array([node])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def near_pairs(a: CoverTree, b: CoverTree, reach: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, bool]]:
    """(nodes of a, nodes of b, which of their pairs, sure): node pairs that hold, each once, all pairs of a point of a and one of b within reach.

    Two nodes whose centres are farther apart than their radii and reach together have no such pair; where centres and radii
    together stay within reach all their pairs are such (sure). Pairs of leaves that are neither have to be verified. Frontiers of nodes are compared as
    matrices of a bounded size; leaves that meet the same node go down together.
    """
    todo = [(np.array([0]), np.array([0]))]
    while todo:
        x, y = todo.pop()
        if len(x) * len(y) > GAPS and len(x) > 1:
            todo += [(x[: len(x) // 2], y), (x[len(x) // 2 :], y)]
            continue
        gap = _distances(a.points[a.center[x]], b.points[b.center[y]])
        both = a.radius[x][:, None] + b.radius[y][None, :]
        sure = gap + both <= reach - ROUNDING
        open_ = (gap <= both + reach + ROUNDING) & ~sure
        if sure.any():
            yield x, y, sure, True
        inner_x, inner_y = a.children[x] > 0, b.children[y] > 0
        leaves = open_ & ~inner_x[:, None] & ~inner_y[None, :]
        if leaves.any():
            yield x, y, leaves, False
        for j in np.flatnonzero(inner_y & open_[~inner_x].any(0)):
            todo.append((x[open_[:, j] & ~inner_x], b.below(y[j])))
        for i in np.flatnonzero(inner_x & open_[:, ~inner_y].any(1)):
            todo.append((a.below(x[i]), y[open_[i] & ~inner_y]))
        for i, j in np.argwhere(open_ & inner_x[:, None] & inner_y[None, :]):
            todo.append((a.below(x[i]), b.below(y[j])))


def cell_links(threshold: float):
    """A task: a cell's members and some of its visitors. Weights linked with each member, and edges that connect what is linked."""
    reach = float(np.sqrt(2.0 - 2.0 * threshold))

    def links(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["vec_id", "h1", "h2"], kind="stable", ignore_index=True)
        raw = np.stack(rows["embedding"].to_numpy()).astype(np.float64)
        norm = np.sqrt(np.einsum("ij,ij->i", raw, raw))
        unit = raw / norm[:, None]
        ids, weight, member = rows["vec_id"].to_numpy(), rows["weight"].to_numpy(np.int64), rows["member"].to_numpy(bool)
        home, away = np.flatnonzero(member), np.flatnonzero(~member)
        count, root = np.zeros(len(rows), np.int64), np.arange(len(rows))

        def found(i: np.ndarray, j: np.ndarray) -> None:
            nonlocal root
            while len(i):
                low = np.minimum(root[i], root[j])
                new = root.copy()
                np.minimum.at(new, root[i], low)
                np.minimum.at(new, root[j], low)
                while not np.array_equal(new, new[new]):
                    new = new[new]
                root = new[root]
                open_ = root[i] != root[j]
                i, j = i[open_], j[open_]

        def tie(tree: CoverTree, points: np.ndarray, nodes: np.ndarray) -> None:
            """The points of each node are connected with one another."""
            for x in nodes[tree.high[nodes] - tree.low[nodes] > 1]:
                own = points[tree.within(x)]
                found(own, np.full(len(own), own[0]))

        def visit(tree: CoverTree, points: np.ndarray, other: CoverTree, others: np.ndarray) -> None:
            """Both may be one tree: then each pair comes from both sides, and a point meets itself."""
            same = tree is other
            upto = np.concatenate([[0], np.cumsum(weight[others[other.order]])])
            more = np.zeros(len(points) + 1, np.int64)  # by place in the tree's order: what is added from there on
            for x, y, pairs, sure in near_pairs(tree, other, reach):
                if sure:
                    total = pairs @ (upto[other.high[y]] - upto[other.low[y]])
                    np.add.at(more, tree.low[x], total)
                    np.add.at(more, tree.high[x], -total)
                    if same:  # a node beside itself: each point has met itself
                        for i in np.flatnonzero(pairs.any(1) & np.isin(x, y)):
                            if pairs[i, np.flatnonzero(y == x[i])].any():
                                own = points[tree.within(x[i])]
                                count[own] -= weight[own]
                    at, to = points[tree.center[x]], others[other.center[y]]
                    p, q = np.nonzero(pairs & (root[at][:, None] != root[to][None, :]))
                    found(at[p], to[q])
                    tie(tree, points, x[pairs.any(1)])
                    tie(other, others, y[pairs.any(0)])
                    continue
                rows_, columns = np.flatnonzero(pairs.any(1)), np.flatnonzero(pairs.any(0))
                to = np.concatenate([others[other.within(k)] for k in y[columns]])
                of = np.repeat(columns, (other.high - other.low)[y[columns]])
                at = np.concatenate([points[tree.within(k)] for k in x[rows_]])
                by = np.repeat(rows_, (tree.high - tree.low)[x[rows_]])
                step = max(1, GAPS // len(to))
                for low in range(0, len(at), step):
                    i = at[low : low + step]
                    ok = (raw[i] @ raw[to].T) / (norm[i][:, None] * norm[to][None, :]) >= threshold
                    ok &= pairs[by[low : low + step][:, None], of[None, :]]
                    if same:
                        ok &= i[:, None] != to[None, :]
                    count[i] += ok @ weight[to]
                    p, q = np.nonzero(ok & (root[i][:, None] != root[to][None, :]))
                    found(i[p], to[q])
            count[points[tree.order]] += np.cumsum(more[:-1])

        if len(home):
            tree = CoverTree(unit[home])
            if rows["first"].iloc[0]:
                visit(tree, home, tree, home)
            if len(away):
                visit(tree, home, CoverTree(unit[away]), away)
        keep = (count > 0) | (root != np.arange(len(rows)))
        return pd.DataFrame({"h1": rows["h1"].to_numpy()[keep], "h2": rows["h2"].to_numpy()[keep], "vec_id": ids[keep], "n": np.where(member, count, 0)[keep], "dst": ids[root[keep]]})

    return links


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, label, embedding (double) of the vectors that can be linked."""
    e = F.col("embedding").cast("array<double>")
    finite = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "label", e.alias("embedding")).where(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite & F.exists(e, lambda x: x != 0)
    )


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.98, pivots: int = MOST_PIVOTS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row: links join vectors with the same label and a cosine of at least the threshold.

    Equal vectors of a label are one point with a weight, told by 128 bits of hash. A bounded set of points, those with the lowest hashes, serves as
    pivots of their labels; each point belongs to the cell of the nearest. A point also visits a cell that, by the cell's radius and by the distance of both pivots, may hold
    a point in reach. Each task builds cover trees of a cell's members and of its visitors and traverses them in
    pairs; bounds discard what can't be linked and take whole pairs of nodes that must be, and the rest is verified in double precision. Large cells
    and crowds of visitors are split over tasks. No pairs leave a task: links are counted, and linked points tied to one of them.

    A vector that is null, zero, or has null or non-finite components, or whose label or dimension has no other, is linked with nothing; so is
    one with a null label. Rows that share a vec_id count one by one as vectors and are returned each, with the id's links summed. A cosine of
    exactly the threshold links. Extra columns are left out; no rows give no rows.
    """
    good = checkpointed(usable(vectors).select("vec_id", "label", "embedding", F.size("embedding").alias("dim"), *(F.xxhash64(F.lit(i), "label", "embedding").alias(f"h{i}") for i in (1, 2))))
    each = good.select("vec_id", "h1", "h2")
    classes = good.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count("*").alias("weight"), F.first(F.struct("label", "embedding", "dim")).alias("v"))
    points = checkpointed(classes.select("h1", "h2", "vec_id", "weight", "v.label", "v.embedding", "v.dim"))
    wanted = int(min(pivots, max(1, points.count() // VECTORS_A_PIVOT)))
    sample = points.orderBy("h1", "h2").limit(wanted).select("label", "dim", "embedding").collect()  # at most MOST_PIVOTS rows
    space: dict = {}
    for r in sample:
        v = np.array(r.embedding)
        space.setdefault((r.label, r.dim), []).append(v / np.sqrt(v @ v))
    space = {k: np.unique(np.stack(v), axis=0) for k, v in space.items()}
    reach = float(np.sqrt(2.0 - 2.0 * threshold)) + ROUNDING

    def units(own: pd.DataFrame) -> np.ndarray:
        raw = np.stack(own["embedding"].to_numpy()).astype(np.float64)
        return raw / np.sqrt(np.einsum("ij,ij->i", raw, raw))[:, None]

    def cells(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, own in batch.groupby(["label", "dim"], sort=False):
                centers = space.get(key)
                gap = _distances(units(own), centers) if centers is not None else np.zeros((len(own), 1))
                yield own.assign(cell=gap.argmin(1), gap=gap.min(1))

    kind = points.schema["label"].dataType.simpleString()
    base = f"h1 long, h2 long, vec_id long, weight long, label {kind}, embedding array<double>, dim int"
    placed = checkpointed(points.mapInPandas(cells, base + ", cell long, gap double"))
    radii: dict = {}
    for r in placed.groupBy("label", "dim", "cell").agg(F.max("gap").alias("radius")).join(small(_labels(space, placed)), ["label", "dim"], "left_semi").collect():
        radii.setdefault((r.label, r.dim), {})[r.cell] = r.radius  # at most a row for each pivot

    def visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, own in batch.groupby(["label", "dim"], sort=False):
                centers, radius = space.get(key), radii.get(key, {})
                if centers is None:
                    yield own.assign(targets=[[] for _ in range(len(own))])
                    continue
                far = np.array([radius.get(c, -9.0) for c in range(len(centers))])
                gap = _distances(units(own), centers)
                may = (gap <= far[None, :] + reach) & (gap - own["gap"].to_numpy()[:, None] <= 2 * reach)
                may[np.arange(len(own)), own["cell"].to_numpy()] = False
                yield own.assign(targets=[np.flatnonzero(m) for m in may])

    visiting = checkpointed(placed.mapInPandas(visits, base + ", cell long, gap double, targets array<long>"))
    key = ["label", "dim", "cell"]
    sizes = visiting.groupBy(*key).agg(F.ceil(F.count("*") / CELL).cast("int").alias("subs"))
    guests = visiting.select("label", "dim", F.explode("targets").alias("cell")).groupBy(*key).agg(F.count("*").alias("guests"))
    plan = sizes.join(guests, key, "left").withColumn("inside", F.col("subs") - 1).withColumn(
        # A part of a cell is also visited by the cell's other parts.
        "chunks", F.greatest(F.lit(1), F.ceil((F.coalesce("guests", F.lit(0)) + F.col("inside") * CELL) / VISITORS)).cast("int")
    ).select(*key, "subs", "chunks")
    plan = small(checkpointed(plan))
    own = visiting.join(plan, key).withColumn("sub", F.pmod("h1", "subs").cast("int"))
    point = ["h1", "h2", "vec_id", "weight", "embedding"]
    members = own.select(*key, "sub", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"), F.lit(True).alias("member"), *point)
    siblings = own.where("subs > 1").withColumn("to", F.explode(F.sequence(F.lit(0), F.col("subs") - 1))).where("to != sub").select(*key, F.col("to").alias("sub"), "chunks", *point)
    strangers = visiting.select("label", "dim", F.explode("targets").alias("cell"), *point).join(plan, key).select(
        *key, F.explode(F.sequence(F.lit(0), F.col("subs") - 1)).alias("sub"), "chunks", *point
    )
    visitors = siblings.union(strangers).select(*key, "sub", F.pmod("h2", "chunks").cast("int").alias("chunk"), F.lit(False).alias("member"), *point)
    tasks = members.union(visitors).withColumn("first", F.col("chunk") == 0)
    found = checkpointed(tasks.groupBy(*key, "sub", "chunk").applyInPandas(cell_links(threshold), "h1 long, h2 long, vec_id long, n long, dst long"))
    links = found.select(F.col("vec_id").alias("src"), "dst").where("src != dst")
    several = each.groupBy("vec_id").agg(F.min("h1").alias("a"), F.max("h1").alias("b")).where("a != b").select("vec_id")
    named = points.select("h1", "h2", F.col("vec_id").alias("rep"), "weight")
    # Rows of different classes that share an id are one node.
    links = links.union(each.join(several, "vec_id").join(named, ["h1", "h2"]).select(F.col("vec_id").alias("src"), F.col("rep").alias("dst")).where("src != dst"))
    components = connected_components(links)
    counts = found.groupBy("h1", "h2").agg(F.sum("n").alias("n"))
    judged = named.join(counts, ["h1", "h2"], "left").join(components, F.col("rep") == F.col("node"), "left").select(
        "h1", "h2", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("component")
    )
    judged = each.join(judged, ["h1", "h2"]).groupBy("vec_id").agg(F.sum("n").alias("n_links"), F.min("component").alias("component"))
    return (
        vectors.select(F.col("vec_id").cast("long").alias("vec_id")).join(judged, "vec_id", "left")
        .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
        .withColumn("kept", F.col("vec_id") == F.col("component_id"))
    )


def _labels(space: dict, placed: DataFrame) -> DataFrame:
    """The labels and dimensions that have pivots, at most as many as there are pivots."""
    kind = placed.schema["label"].dataType.simpleString()
    return placed.sparkSession.createDataFrame([(k[0], int(k[1])) for k in space] or [], f"label {kind}, dim int")


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


#: The same rows by brute force.
OP3_SQL = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))) >= 0.98
), reached AS (
  SELECT vec_id AS node, vec_id AS to_id FROM embeddings
  UNION
  SELECT r.node, l.b FROM reached r JOIN links l ON r.to_id = l.a
)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN (SELECT node, min(to_id) AS component_id FROM reached GROUP BY node) c ON c.node = e.vec_id
"""
