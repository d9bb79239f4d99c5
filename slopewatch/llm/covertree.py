"""Near-duplicate vectors: exact threshold pairs by dual traversal of cover trees, counted and joined without being listed."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from slopewatch.llm.texts import stored
from slopewatch.operators.components import connected

COSINE = 0.93
BLOCK = 1024  # distinct vectors held against as many others at once
PIVOTS = 64  # centres that a label's vectors are dealt to, at most
LEAF = 16
_NEAR = 1e-9  # distances closer to the threshold are decided by the cosine itself


@dataclass
class Node:
    """A ball around one of its members; the kids' balls have half the radius or less."""

    centre: int
    radius: float
    members: np.ndarray
    kids: list[Node] = field(default_factory=list)


def tree(x: np.ndarray) -> Node:
    """Cover tree of unit vectors: every level is a net of half the radius of the one above."""
    far = lambda i, at: np.sqrt(np.maximum(2 - 2 * (x[at] @ x[i]), 0))
    every = np.arange(len(x))
    root = Node(0, float(far(0, every).max()), every)
    todo = [root]
    while todo:
        node = todo.pop()
        if len(node.members) <= LEAF or node.radius < _NEAR:
            continue
        left = node.members
        while len(left):  # the first one left is the next centre
            d = far(left[0], left)
            own = d <= node.radius / 2
            own[0] = True
            node.kids.append(Node(int(left[0]), float(d[own].max()), left[own]))
            left = left[~own]
        todo.extend(node.kids)
    return root


def traversed(a: Node, b: Node, x: np.ndarray, y: np.ndarray, cosine: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks (rows of x, rows of y, linked) that hold every linked pair once; pairs of one set in one direction or within a node.

    A pair of nodes is dropped when even its nearest members are beyond the threshold
    distance, and taken whole when even its farthest are within.
    """
    reach = np.sqrt(2 - 2 * cosine)
    todo = [(a, b)]
    while todo:
        p, q = todo.pop()
        if not p.kids and not q.kids:
            link = x[p.members] @ y[q.members].T >= cosine
            if same and p is q:
                np.fill_diagonal(link, False)
            if link.any():
                yield p.members, q.members, link
            continue
        us, vs = p.kids or [p], q.kids or [q]
        d = np.sqrt(np.maximum(2 - 2 * x[[u.centre for u in us]] @ y[[v.centre for v in vs]].T, 0))
        span = np.array([u.radius for u in us])[:, None] + np.array([v.radius for v in vs])[None, :]
        maybe, sure = d - span <= reach + _NEAR, d + span < reach - _NEAR
        if same and p is q:  # each pair of different kids once, each kid with itself
            upper = np.triu(np.ones_like(maybe))
            maybe, sure = maybe & upper, sure & np.triu(upper, 1)
            maybe |= np.eye(len(us), dtype=bool)
        single_u, single_v = np.array([len(u.members) for u in us]) == 1, np.array([len(v.members) for v in vs]) == 1
        points = sure & single_u[:, None] & single_v[None, :]
        if points.any():  # singletons in one matrix
            i, j = np.flatnonzero(points.any(axis=1)), np.flatnonzero(points.any(axis=0))
            yield np.array([us[k].centre for k in i]), np.array([vs[k].centre for k in j]), points[np.ix_(i, j)]
        for i, j in np.argwhere(sure & ~points):
            yield us[i].members, vs[j].members, np.ones((len(us[i].members), len(vs[j].members)), bool)
        for i, j in np.argwhere(maybe & ~sure):
            u, v = us[i], vs[j]
            if not (same and p is q and i == j and len(u.members) == 1):
                todo.append((u, v))


def linked(left: pd.DataFrame, right: pd.DataFrame | None, cosine: float) -> pd.DataFrame:
    """(node, to, n): linked vectors of each node in the other block, and the node its component inside the two is named after."""
    same = right is None
    right = left if same else right
    x, y = np.stack(left["unit"]), np.stack(right["unit"])
    wx, wy = left["copies"].to_numpy(), right["copies"].to_numpy()
    nx, ny = left["node"].to_numpy(), right["node"].to_numpy()
    a = tree(x)
    blocks = list(traversed(a, a if same else tree(y), x, y, cosine, same))
    cx, cy = np.zeros(len(x), np.int64), np.zeros(len(y), np.int64)
    lx = nx.copy()
    ly = lx if same else ny.copy()
    for rows, columns, link in blocks:
        cx[rows] += link @ wy[columns]
        if not (same and rows is columns):
            cy[columns] += wx[rows] @ link
    top, moved = np.iinfo(np.int64).max, True
    while moved:
        moved = False
        for rows, columns, link in blocks:
            low_x = np.minimum(lx[rows], np.where(link, ly[columns][None, :], top).min(axis=1))
            low_y = np.minimum(ly[columns], np.where(link, low_x[:, None], top).min(axis=0))
            moved |= bool((low_x < lx[rows]).any() or (low_y < ly[columns]).any())
            lx[rows] = np.minimum(lx[rows], low_x)
            ly[columns] = np.minimum(ly[columns], low_y)
    out = pd.DataFrame({"node": nx, "to": lx, "n": cx + cy if same else cx})
    out = out if same else pd.concat([out, pd.DataFrame({"node": ny, "to": ly, "n": cy})])
    return out[out["n"] > 0]


def _chord(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, x: t + x)
    return F.sqrt(F.greatest(2 - 2 * dot, F.lit(0.0)))


def _units(points: DataFrame, cosine: float) -> DataFrame:
    """Rows (label, dim, p, q, side, node, copies, unit): the pairs of blocks that may hold links, with their vectors.

    Vectors of a large label are dealt to the nearest of a few centres, drawn by
    hash; a centre's vectors are cut into blocks. Two blocks meet unless their
    balls are farther apart than the threshold distance.
    """
    key = ["label", "dim"]
    sizes = points.groupBy(*key).agg(F.count(F.lit(1)).alias("total"))
    rate = F.least(F.lit(float(PIVOTS)), F.ceil(F.col("total") / BLOCK)) / F.col("total")
    draw = F.pmod(F.xxhash64("node", F.lit(17)), F.lit(1 << 40)) / float(1 << 40)
    sample = points.join(sizes.filter(F.col("total") > BLOCK), key).filter(draw < rate)
    centres = sample.groupBy(*key).agg(F.sort_array(F.collect_list("unit")).alias("centres"))  # about PIVOTS of a label
    nearest = F.array_min(F.transform("centres", lambda c, i: F.struct(_chord(c, F.col("unit")).alias("r"), i.alias("i"))))
    dealt = points.join(centres, key, "left").withColumn("_at", nearest).select(
        *key, "node", "copies", "unit", F.coalesce("_at.i", F.lit(-1)).alias("cell"), F.coalesce("_at.r", F.lit(2.0)).alias("r"), F.element_at("centres", F.col("_at.i") + 1).alias("centre")
    )
    dealt = stored(dealt, "dealt")
    cells = dealt.groupBy(*key, "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    placed = stored(dealt.join(cells, [*key, "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")).drop("parts"), "placed")
    blocks = placed.groupBy(*key, "cell", "part").agg(F.max("r").alias("r"), F.first("centre").alias("centre"))
    name = F.struct("cell", "part")
    first = blocks.select(*key, name.alias("p"), F.col("r").alias("rp"), F.col("centre").alias("cp"))
    second = blocks.select(*key, name.alias("q"), F.col("r").alias("rq"), F.col("centre").alias("cq"))
    reach = float(np.sqrt(2 - 2 * cosine)) + _NEAR
    meet = F.col("cp").isNull() | F.col("cq").isNull() | (_chord(F.col("cp"), F.col("cq")) - F.col("rp") - F.col("rq") <= reach)
    pairs = first.join(second, key).filter((F.col("p") <= F.col("q")) & meet).select(*key, "p", "q")
    sides = pairs.select(*key, "p", "q", F.lit(0).alias("side"), F.col("p").alias("own")).unionByName(
        pairs.filter("p != q").select(*key, "p", "q", F.lit(1).alias("side"), F.col("q").alias("own"))
    )
    return sides.join(placed.select(*key, name.alias("own"), "node", "copies", "unit"), [*key, "own"]).drop("own")


def grouped(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every row of ``vectors(vec_id, embedding, label)``.

    Vectors of one label and length are linked at ``cosine`` or more, in double
    precision. ``component_id`` is the smallest vec_id reachable, ``kept`` marks
    it. Equal vectors are one node with a number of copies, all linked. A vector
    that is null, empty, zero, or holds a null or non-finite component, or whose
    label is null, links with nothing. Null vec_ids count as below all others;
    repeated rows count as copies. Extra columns are ignored; empty input gives no rows.
    """
    low = F.lit(-(1 << 63))
    wide = F.col("embedding").cast("array<double>")
    finite = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda t, v: t + v * v))
    base = vectors.select(F.coalesce("vec_id", low).alias("vec_id"), "label", wide.alias("embedding"))
    able = F.col("label").isNotNull() & F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False))
    rows = stored(
        base.withColumn("norm", F.when(able, norm)).withColumn("node", F.when(F.col("norm") > 0, F.xxhash64("label", "embedding"))), "vectors"
    )
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"), F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.first("norm").alias("norm")
    )
    nodes = stored(nodes.select("node", "vec_id", "copies", "label", F.size("embedding").alias("dim"), F.transform("embedding", lambda v: v / F.col("norm")).alias("unit")), "nodes")
    unit = ["label", "dim", "p", "q"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def work(rows: pd.DataFrame) -> pd.DataFrame:
            own, other = rows[rows["side"] == 0], rows[rows["side"] == 1]
            return linked(own, other if len(other) else None, cosine)

        rest = None
        for batch in batches:
            rows = batch if rest is None else pd.concat([rest, batch])
            last = (rows["unit_id"] == rows["unit_id"].iloc[-1]).to_numpy()
            rest = rows[last]
            for _, group in rows[~last].groupby("unit_id", sort=False):
                yield work(group)
        if rest is not None and len(rest):
            yield work(rest)

    units = _units(nodes, cosine).withColumn("unit_id", F.xxhash64(*unit)).select("unit_id", "side", "node", "copies", "unit")
    found = stored(units.repartition("unit_id").sortWithinPartitions("unit_id").mapInPandas(run, "node long, to long, n long"), "links")
    counts = found.groupBy("node").agg(F.sum("n").alias("n"))
    edges = found.filter("node != to").select(F.lit(0).alias("scope"), F.col("node").alias("a"), F.col("to").alias("b")).distinct()
    ends = edges.select("scope", F.col("a").alias("id")).union(edges.select("scope", F.col("b").alias("id"))).distinct()
    labels = connected(ends, edges).select(F.col("id").alias("node"), F.col("label").alias("group"))
    named = nodes.select("node", "vec_id").join(labels, "node")
    first = named.groupBy("group").agg(F.min("vec_id").alias("component_id"))
    told = nodes.select("node", "vec_id", "copies").join(counts, "node", "left").join(named.join(first, "group").select("node", "component_id"), "node", "left").select(
        "node", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")
    )
    out = rows.select("vec_id", "node").join(told, "node", "left").withColumn("component_id", F.coalesce("component_id", "vec_id"))
    real = lambda c: F.nullif(F.col(c), low)
    return out.select(real("vec_id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"), real("component_id").alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))


#: The same rows in SQL.
SQL = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), ok AS (
  SELECT * FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(e, lambda x: x * x)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}
), reach AS (
  SELECT vec_id AS id, vec_id AS to_id FROM v UNION SELECT r.id, l.b FROM reach r JOIN links l ON r.to_id = l.a
), comp AS (
  SELECT id, min(to_id) AS component_id FROM reach GROUP BY id
), n AS (
  SELECT a, count(*) AS n FROM links GROUP BY a
)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, v.vec_id = c.component_id AS kept
FROM v JOIN comp c ON v.vec_id = c.id LEFT JOIN n ON v.vec_id = n.a
"""
