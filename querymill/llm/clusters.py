"""Clusters of similar vectors by bisecting k-means, and the exact sets that similar pairs join.

Equal directions are collapsed first. Nodes with more than NODE_ROWS vectors are split across the cluster: all workers route their vectors
through the tree so far and send back sums, a few numbers a node. Smaller nodes are finished in one task each, always splitting the node of
largest dispersion, until every leaf is compact. The leaves give sizes and centre-nearest members.

Similar pairs are then looked up exactly: within each node, and between those pairs of nodes that the angles of their centres and their
radii don't rule out, as products of blocks; what they join is reduced to links between local sets and resolved as connected
components.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from querymill.operators.graph import components
from querymill.session import materialise

NODE_ROWS = 8192
COMPACT = 0.9  # least cosine of a leaf's members to its centre
LLOYD = 3
BLOCK_TILES, MOST_BLOCKS_OF_ONE = 16, 64  # tiles of one block; up to so many tiles each is a block of its own
_CHUNK = 1024


def unit_vectors(df: DataFrame, id_col: str, vector_col: str, dim: int) -> DataFrame:
    """(id, unit): the direction of each usable vector as bytes. Vectors that are null, zero, of another length, or with a null, infinite or
    not-a-number element are left out, as are null ids."""

    def normalise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.array(batch.column(1).flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, dim)
            size = np.linalg.norm(x, axis=1)
            good = np.isfinite(size) & (size > 0)
            unit = np.ascontiguousarray((x[good] / size[good, None]).astype(np.float32) + np.float32(0))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), pa.array([u.tobytes() for u in unit], pa.binary())], ["id", "unit"])

    v = F.col(vector_col)
    rows = df.where(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) == dim) & ~F.exists(v, lambda x: x.isNull()))
    return rows.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).mapInArrow(normalise, "id long, unit binary")


def _matrix(column: pa.Array) -> np.ndarray:
    raw = b"".join(column.to_pylist())
    return np.frombuffer(raw, np.float32).reshape(len(column), -1)


def route(x: np.ndarray, tree: dict[int, tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """The node each vector ends in; the children of node k are 2k + 1 and 2k + 2."""
    at = np.zeros(len(x), np.int64)
    todo = [0]
    while todo:
        k = todo.pop()
        if k in tree:
            rows = np.flatnonzero(at == k)
            if len(rows):  # only the paths that vectors take are walked
                at[rows] = 2 * k + 1 + (x[rows] @ (tree[k][1] - tree[k][0]) > 0)
                todo += [2 * k + 1, 2 * k + 2]
    return at


def _sums(units: DataFrame, tree: dict) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """Number, sum and a far member of each node that has vectors."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            x = _matrix(batch.column(0))
            at = route(x, tree)
            for k in np.unique(at):
                own = x[at == k].astype(np.float64)
                n, s, far = total.get(k, (0, 0.0, own[0]))
                s = s + own.sum(axis=0)
                total[k] = (n + len(own), s, min([far, *own[(own @ s).argmin()][None]], key=lambda v: v @ s / np.linalg.norm(v)))
        yield from _node_rows(total)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for batch in batches:
            for k, n, s, far in zip(*(batch.column(c).to_pylist() for c in range(4))):
                s, far = np.frombuffer(s), np.frombuffer(far)
                if k in total:
                    m, t, other = total[k]
                    s = s + t
                    n, far = n + m, min((far, other), key=lambda v: v @ s)
                total[k] = (n, s, far)
        yield from _node_rows(total)

    shape = "node long, n long, s binary, far binary"
    rows = units.select("unit").mapInArrow(partial, shape).repartition("node").mapInArrow(merge, shape).collect()
    return {r.node: (r.n, np.frombuffer(bytes(r.s)), np.frombuffer(bytes(r.far))) for r in rows}


def _node_rows(total: dict) -> Iterator[pa.RecordBatch]:
    if total:
        ks = list(total)
        yield pa.RecordBatch.from_arrays([pa.array([int(k) for k in ks], pa.int64()), pa.array([total[k][0] for k in ks], pa.int64()), *[pa.array([np.ascontiguousarray(total[k][j]).tobytes() for k in ks], pa.binary()) for j in (1, 2)]], ["node", "n", "s", "far"])


def _direction(v: np.ndarray) -> np.ndarray:
    return (v / max(np.linalg.norm(v), 1e-12)).astype(np.float32)


def grow(units: DataFrame, node_rows: int = NODE_ROWS, levels: int = 40) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The upper tree: every node with more than node_rows vectors is split, all of a level in the same passes over the vectors: LLOYD of them to
    settle the centres, the last of which gives the sizes that the next level starts from."""
    tree: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    stuck: set[int] = set()
    stats = _sums(units, tree)
    for _ in range(levels):
        large = [k for k, (n, _, _) in stats.items() if n > node_rows and k not in stuck]
        if not large:
            break
        for k in large:
            n, s, far = stats[k]
            centre = s / n
            away = _direction(far) - centre
            tree[k] = (_direction(centre - 0.5 * away), _direction(centre + 0.5 * away))
        for step in range(LLOYD):
            stats = _sums(units, tree)
            for k in large:
                a, b = stats.get(2 * k + 1), stats.get(2 * k + 2)
                if a and b and step < LLOYD - 1:
                    tree[k] = (_direction(a[1]), _direction(b[1]))
        gone = [k for k in large if 2 * k + 1 not in stats or 2 * k + 2 not in stats]
        for k in gone:  # all its vectors went to one side
            del tree[k]
            stuck.add(k)
            stats[k] = stats.pop(2 * k + 1, None) or stats.pop(2 * k + 2)
    return tree


def bisect(x: np.ndarray, compact: float = COMPACT) -> np.ndarray:
    """Leaf number of each row: the node of largest dispersion is split first, until all members of every leaf are close to its centre."""
    leaf = np.zeros(len(x), np.int64)

    def entry(rows: np.ndarray) -> tuple:
        s = x[rows].sum(axis=0)
        return (float(np.linalg.norm(s)) - len(rows), int(rows[0]), rows, s)

    heap, done = [entry(np.arange(len(x)))] if len(x) else [], 0
    while heap:
        _, _, rows, s = heapq.heappop(heap)
        own = x[rows]
        cos = own @ _direction(s)
        if len(rows) == 1 or cos.min() >= compact:
            leaf[rows] = done
            done += 1
            continue
        far = own[cos.argmin()]
        other = own[(own @ far).argmin()]
        for _ in range(LLOYD):
            right = own @ (far - other) > 0
            if right.all() or not right.any():
                break
            far, other = _direction(own[right].sum(axis=0)), _direction(own[~right].sum(axis=0))
        if right.all() or not right.any():
            right = np.arange(len(rows)) == cos.argmin()
        heapq.heappush(heap, entry(rows[right]))
        heapq.heappush(heap, entry(rows[~right]))
    return leaf


def _join(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a and b; labels are the smallest row of each set."""
    pairs = np.unique(np.stack([np.minimum(labels[a], labels[b]), np.maximum(labels[a], labels[b])]), axis=1)
    pairs = pairs[:, pairs[0] != pairs[1]]
    if not pairs.size:
        return
    root: dict[int, int] = {}

    def find(k: int) -> int:
        while k in root:
            if root[k] in root:
                root[k] = root[root[k]]
            k = root[k]
        return k

    for p, q in pairs.T.tolist():
        p, q = find(p), find(q)
        if p != q:
            root[max(p, q)] = min(p, q)
    moved = np.arange(len(labels))
    moved[list(root)] = [find(k) for k in root]
    labels[:] = moved[labels]


def leaf_blocks(x: np.ndarray, leaf_x: np.ndarray, y: np.ndarray, leaf_y: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of x and of y to compare, about _CHUNK rows of x at once: whole leaves, with the leaves of y that may hold a vector similar to one of theirs
    by the angle of their centres and their radii. By the triangle inequality of angles no similar pair is outside."""

    reach = float(np.arccos(least)) + 1e-3

    def ordered(z: np.ndarray, leaf: np.ndarray, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Rows by leaf, sizes, and for each leaf its centre with two numbers more: the product of one of x and one of y is at least 0 where the cosine of the centres
        is at least that of the sum of both radii and the reach, as cos(a + b) = cos a cos b - sin a sin b."""
        names, at = np.unique(leaf, return_inverse=True)
        centres = np.zeros((len(names), z.shape[1] + 2), np.float32)
        np.add.at(centres[:, :-2], at, z)
        centres[:, :-2] /= np.maximum(np.linalg.norm(centres[:, :-2], axis=1, keepdims=True), 1e-12)
        radius = np.zeros(len(names))
        np.maximum.at(radius, at, np.arccos(np.clip((z * centres[at, :-2]).sum(axis=1), -1, 1)))
        radius = np.minimum(radius, (np.pi - reach) / 2) + (reach if own else 0)
        centres[:, -2], centres[:, -1] = -np.cos(radius) if own else np.cos(radius), np.sin(radius)
        return np.argsort(at, kind="stable"), np.bincount(at), centres

    rows_x, sizes_x, centres_x = ordered(x, leaf_x, True)
    rows_y, sizes_y, centres_y = ordered(y, leaf_y, False)
    ends, first = np.cumsum(sizes_x), 0
    while first < len(ends):
        begin = ends[first] - sizes_x[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + _CHUNK, "right")))
        near = (centres_x[first:last] @ centres_y.T >= -1e-3).any(axis=0)
        cols = rows_y[np.repeat(near, sizes_y)]
        for cut in range(begin, ends[last - 1], _CHUNK):  # one leaf may be larger
            if len(cols):
                yield rows_x[cut : min(cut + _CHUNK, ends[last - 1])], cols
        first = last


def local_sets(x: np.ndarray, least: float, leaf: np.ndarray | None = None) -> np.ndarray:
    """Smallest row that each row is joined to by pairs with at least the given cosine; with leaves, only leaves that may hold such a pair are compared."""
    labels = np.arange(len(x))
    leaf = np.zeros(len(x), np.int64) if leaf is None else leaf
    for rows, cols in leaf_blocks(x, leaf, x, leaf, least):
        a, b = np.nonzero(x[rows] @ x[cols].T >= least)
        a, b = rows[a], cols[b]
        _join(labels, a[b > a], b[b > a])
    return labels


def tiles(units: DataFrame, tree: dict, least: float, compact: float, node_rows: int) -> DataFrame:
    """One row for each node (cut by hash where it can't be split): its ids, vectors, leaves and local sets."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(route(_matrix(batch.column(1)), tree), pa.int64())], ["id", "unit", "n", "node"])

    def finish(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("id")
        x, ids = np.frombuffer(b"".join(group["unit"]), np.float32).reshape(len(group), -1), group["id"].to_numpy()
        leaf = bisect(x, compact)
        centres = np.zeros((leaf.max() + 1, x.shape[1]), np.float32)
        np.add.at(centres, leaf, x)
        centres /= np.maximum(np.linalg.norm(centres, axis=1, keepdims=True), 1e-12)
        cos = (x * centres[leaf]).sum(axis=1)
        first = np.full(leaf.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(first, leaf, ids)
        sets = ids[local_sets(x, least, leaf)]
        centre = _direction(x.sum(axis=0))
        radius = float(np.arccos(np.clip((x @ centre).min(), -1, 1)))
        return pd.DataFrame([{"tile": int(ids[0]), "rows": len(x), "ids": ids.tobytes(), "units": x.tobytes(), "n": group["n"].to_numpy(np.int64).tobytes(), "leaves": first[leaf].tobytes(), "cosines": cos.astype(np.float64).tobytes(), "sets": sets.tobytes(), "centre": centre.tobytes(), "radius": radius}])

    placed = units.select("id", "unit", "n").mapInArrow(place, "id long, unit binary, n long, node long")
    sizes = placed.groupBy("node").agg(F.ceil(F.count("*") / node_rows).alias("cuts"))
    cut = placed.join(F.broadcast(sizes), "node").withColumn("cut", F.pmod(F.xxhash64("id"), "cuts"))
    return cut.groupBy("node", "cut").applyInPandas(finish, "tile long, rows long, ids binary, units binary, n binary, leaves binary, cosines binary, sets binary, centre binary, radius double")


def cross_links(tile_rows: DataFrame, least: float) -> DataFrame:
    """(a, b): local sets of different tiles that a similar pair joins. Tiles are put into blocks, and a task compares two blocks, so that a tile is sent once for
    each block and not for each tile. Tiles too far apart to hold a similar pair, by the angle of their centres and their
    radii, aren't compared; of the others, only leaves that may hold one. Nothing of this passes the driver."""
    count = tile_rows.count()
    blocks = max(1, count if count < MOST_BLOCKS_OF_ONE else -(-count // BLOCK_TILES))
    reach = float(np.arccos(least)) + 1e-3
    own = F.pmod(F.xxhash64("tile"), F.lit(blocks)).cast("long")
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))
    sides = tile_rows.select(own.alias("own"), other.alias("other"), "tile", "units", "leaves", "sets", "centre", "radius")
    sides = sides.select(F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "own", "tile", "units", "leaves", "sets", "centre", "radius")

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        p, q = int(group["p"].iloc[0]), int(group["q"].iloc[0])
        tiles_ = [(r.own, np.frombuffer(r.sets, np.int64), np.frombuffer(r.leaves, np.int64), r.units, np.frombuffer(r.centre, np.float32), r.radius) for r in group.sort_values("tile").itertuples()]
        found = [np.zeros((2, 0), np.int64)]
        for i, one in enumerate(tiles_):
            for two in tiles_[i + 1 :]:
                if (p != q and one[0] == two[0]) or np.arccos(np.clip(one[4] @ two[4], -1, 1)) > one[5] + two[5] + reach:
                    continue
                x, y = (np.frombuffer(t[3], np.float32).reshape(len(t[1]), -1) for t in (one, two))
                for rows, cols in leaf_blocks(x, one[2], y, two[2], least):
                    a, b = np.nonzero(x[rows] @ y[cols].T >= least)
                    if len(a):
                        found.append(np.unique(np.stack([one[1][rows[a]], two[1][cols[b]]]), axis=1))
        links = np.unique(np.concatenate(found, axis=1), axis=1)
        return pd.DataFrame({"a": links[0], "b": links[1]})

    return sides.repartition(min(4096, blocks * (blocks + 1) // 2), "p", "q").groupBy("p", "q").applyInPandas(compare, "a long, b long")


def _unpack(tile_rows: DataFrame) -> DataFrame:
    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                kinds = {"ids": np.int64, "n": np.int64, "leaves": np.int64, "cosines": np.float64, "sets": np.int64}
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(row[k], t)) for k, t in kinds.items()], ["id", "n", "leaf", "cosine", "set"])

    return tile_rows.select("ids", "n", "leaves", "cosines", "sets").mapInArrow(members, "id long, n long, leaf long, cosine double, set long")


def _prepared(df: DataFrame, id_col: str, vector_col: str, dim: int, least: float, compact: float, node_rows: int) -> tuple[DataFrame, DataFrame]:
    rows = materialise(unit_vectors(df, id_col, vector_col, dim), "vectors")
    units = materialise(rows.groupBy("unit").agg(F.min("id").alias("id"), F.count("*").alias("n")), "directions")
    return rows, materialise(tiles(units, grow(units, node_rows), least, compact, node_rows), "tiles")


def similarity_clusters(df: DataFrame, id_col: str, vector_col: str, dim: int = 64, least: float = 0.85, smallest: int = 3, compact: float = COMPACT, node_rows: int = NODE_ROWS) -> DataFrame:
    """(cluster_id, id): the members of each set of at least `smallest` records that pairs with a cosine of at least `least` join, directly or over
    others; cluster_id is the smallest id. Vectors that unit_vectors leaves out belong to none; equal vectors are members of their own; an empty table gives
    no row. Other columns are ignored, whatever their names."""
    rows, tile_rows = _prepared(df, id_col, vector_col, dim, least, compact, node_rows)
    joined = components(cross_links(tile_rows, least)).withColumnRenamed("id", "set")
    own = _unpack(tile_rows).join(joined, "set", "left").select(F.col("id").alias("first"), "n", F.coalesce("component", "set").alias("cluster_id"))
    large = own.groupBy("cluster_id").agg(F.sum("n").alias("size")).where(F.col("size") >= smallest).select("cluster_id")
    firsts = materialise(own.join(large, "cluster_id").select("first", "cluster_id"), "cluster-firsts")
    units = rows.groupBy("unit").agg(F.min("id").alias("first"))
    return rows.join(units.join(firsts, "first"), "unit").select("cluster_id", "id")


def leaf_report(df: DataFrame, id_col: str, vector_col: str, dim: int = 64, least: float = 0.85, typical: int = 3, compact: float = COMPACT, node_rows: int = NODE_ROWS) -> DataFrame:
    """(leaf, size, members, least_cosine, typical): each leaf of the tree by its smallest id, its number of records and of different vectors, how compact it is,
    and the ids of its centre-nearest members."""
    _, tile_rows = _prepared(df, id_col, vector_col, dim, least, compact, node_rows)
    rows = _unpack(tile_rows)
    near = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("cosine")).alias("c"), "id"))), 1, typical)
    ranked = rows.withColumn("k", F.row_number().over(W.partitionBy("leaf").orderBy(F.desc("cosine"), "id"))).where(F.col("k") <= typical)
    best = ranked.groupBy("leaf").agg(F.array_join(F.transform(near, lambda x: x["id"].cast("string")), " ").alias("typical"))
    sizes = rows.groupBy("leaf").agg(F.sum("n").alias("size"), F.count("*").alias("members"), F.min("cosine").alias("least_cosine"))
    return sizes.join(best, "leaf")
