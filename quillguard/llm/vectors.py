"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Equal vectors of a label are one class with a multiplicity. Unit vectors are rotated to their principal axes (from sums over
all vectors), ordered by label and coarse cells of the leading coordinates, and cut into tiles of consecutive rows with the
box of their leading coordinates. Tile pairs of one label whose boxes are near enough are compared: products of the leading
coordinates first; the rest of a product is at most the product of the suffix norms, so the comparison of a tile stops when
no cosine can reach the threshold, and goes on with the pairs that still can. Tile pairs are gathered by pairs of groups of `GROUP` tiles, so a
tile's vectors travel once to each group near it, not to each tile. A tile pair gives the number of links of each
vector and a spanning forest, never the pairs themselves; components come from the forests.

Defined results: a vector that is null, empty, zero or has a null or non-finite component, or whose label or vec_id is null,
links with nothing; vectors of different dimensions don't link; a row that repeats another in all three columns is one vector
with it; rows with one vec_id but different vectors are vectors of their own, components join by vec_id; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, drop, materialize, table
from .graph import components

THRESHOLD = 0.93
TILE = 512
#: Consecutive tiles whose pairs with another such group are compared in one go: at most 2 * GROUP * TILE vectors in memory.
GROUP = 16
#: Leading coordinates of a tile's box.
BOX = 8
#: Coordinates summed before each look at the bound.
BLOCKS = (8, 16, 32)
_SLACK = 1e-9


def _valid() -> F.Column:
    x = F.col("embedding")
    # an infinity or NaN minus itself isn't 0
    return F.coalesce(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size(x) > 0) & F.forall(x, lambda v: F.coalesce((v - v) == 0, F.lit(False))) & F.exists(x, lambda v: v != 0), F.lit(False))


def principal_axes(classes: DataFrame) -> dict[int, "np.ndarray"]:
    """By dimension, the axes as columns, by falling variance: from sums of products over all vectors, added up by Spark."""
    import numpy as np
    import pyarrow as pa

    def run(batches):
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for x in _unit(b.column(0)):
                d = x.shape[1]
                total[d] = total.get(d, 0) + x.T @ x
        for d, s in total.items():
            i, j = np.triu_indices(d)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), d, "i4")), pa.array(i.astype("i4")), pa.array(j.astype("i4")), pa.array(s[i, j])], ["d", "i", "j", "s"])

    out: dict = {}
    # d * (d + 1) / 2 rows a dimension
    for r in classes.select("embedding").mapInArrow(run, "d int, i int, j int, s double").groupBy("d", "i", "j").agg(F.sum("s").alias("s")).toLocalIterator():
        m = out.setdefault(r["d"], np.zeros((r["d"], r["d"])))
        m[r["i"], r["j"]] = m[r["j"], r["i"]] = r["s"]
    return {d: np.linalg.eigh(m)[1][:, ::-1].copy() for d, m in out.items()}


def _unit(column):
    """Arrays of unit vectors of a column of lists, one array a dimension; in the order of the rows if all have one."""
    import numpy as np

    n = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.concatenate(([0], np.cumsum(n)))
    for d in np.unique(n):
        own = np.flatnonzero(n == d)
        x = flat.reshape(-1, d) if len(own) == len(n) else np.stack([flat[at[i] : at[i] + d] for i in own])
        x = x / np.abs(x).max(1, keepdims=True)
        yield x / np.sqrt((x * x).sum(1, keepdims=True))


def make_tiles(classes: DataFrame, axes: dict, threshold: float, tile: int = TILE) -> DataFrame:
    """classes: label, embedding, rep, mult. Tiles: tile, label, d, lo, hi, n, ids, mults, vectors (binary)."""
    import pyarrow as pa

    width = math.sqrt(2 - 2 * threshold) / 2

    def cells(batches):
        import numpy as np

        for b in batches:
            n = b.column(1).value_lengths().to_numpy(zero_copy_only=False)
            c = np.zeros((len(n), 3), "i4")
            for d, x in zip(np.unique(n), _unit(b.column(1))):
                y = x @ axes[int(d)][:, :3]
                c[n == d, : y.shape[1]] = np.floor(y / width)
            vectors = b.column(1).cast(pa.list_(pa.float64()))
            raw, at = vectors.flatten().to_numpy(zero_copy_only=False), np.concatenate(([0], np.cumsum(n)))
            blobs = pa.array([raw[at[i] : at[i + 1]].tobytes() for i in range(len(n))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n.astype("i4")), *[pa.array(c[:, k]) for k in range(3)], b.column(2), b.column(3), blobs], ["label", "d", "c0", "c1", "c2", "rep", "mult", "vector"])

    order = ["label", "d", "c0", "c1", "c2", "rep"]
    placed = classes.select(F.col("label").cast("long").alias("label"), "embedding", "rep", "mult").mapInArrow(cells, "label long, d int, c0 int, c1 int, c2 int, rep long, mult long, vector binary")
    ordered = materialize(placed).repartitionByRange(*order).sortWithinPartitions(*order)
    names = ["tile", "label", "d", "lo", "hi", "ids", "mults", "vectors"]

    def cut(batches):
        import numpy as np
        from pyspark import TaskContext

        base, k, rows, key = TaskContext.get().partitionId() << 40, 0, [], None

        def out():
            label, d = key
            x = np.frombuffer(b"".join(r[2] for r in rows)).reshape(-1, d)
            y = x / np.abs(x).max(1, keepdims=True)
            y = (y / np.sqrt((y * y).sum(1, keepdims=True))) @ axes[d][:, :BOX]
            box = np.zeros((2, BOX))
            box[:, : y.shape[1]] = y.min(0), y.max(0)
            row = [[base + k], [label], [d], [box[0].tolist()], [box[1].tolist()], [np.array([r[0] for r in rows], "i8").tobytes()], [np.array([r[1] for r in rows], "i8").tobytes()], [x.tobytes()]]
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, kinds)], names)

        for b in batches:
            for label, d, rep, mult, v in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("label", "d", "rep", "mult", "vector"))):
                if rows and (key != (label, d) or len(rows) == tile):
                    yield out()
                    k, rows = k + 1, []
                key = (label, d)
                rows.append((rep, mult, v))
        if rows:
            yield out()

    return materialize(ordered.mapInArrow(cut, "tile long, label long, d int, lo array<double>, hi array<double>, ids binary, mults binary, vectors binary"))


def tile_pairs(tiles: DataFrame, threshold: float) -> DataFrame:
    """a, b (a <= b) of the tile pairs of one label and dimension whose boxes are near enough.

    Only the boxes take part. Tiles meet in cells of the first two coordinates as wide as the distance that the threshold allows.
    """
    far = 2 - 2 * threshold + 1e-6
    width = math.sqrt(far)
    cell = lambda x: F.floor(x / F.lit(width)).cast("int")

    def cells(box: DataFrame, lo: str, hi: str, more: float, *rest: str) -> DataFrame:
        """A row for each cell of the first two coordinates that the box, wider by `more`, meets."""
        spans = [F.sequence(cell(F.col(lo)[k] - more), cell(F.col(hi)[k] + more)) for k in (0, 1)]
        return box.select("*", F.explode(spans[0]).alias("c0")).select("*", F.explode(spans[1]).alias("c1")).select(*rest, "label", "d", lo, hi, "c0", "c1")

    meta = tiles.select("tile", "label", "d", "lo", "hi")
    left = cells(meta.select(F.col("tile").alias("a"), "label", "d", F.col("lo").alias("alo"), F.col("hi").alias("ahi")), "alo", "ahi", 0.0, "a")
    right = cells(meta.select(F.col("tile").alias("b"), "label", "d", "lo", "hi"), "lo", "hi", width, "b")
    gap = F.zip_with(F.zip_with("lo", "ahi", lambda x, y: F.greatest(x - y, F.lit(0.0))), F.zip_with("alo", "hi", lambda x, y: F.greatest(x - y, F.lit(0.0))), lambda x, y: F.greatest(x, y))
    apart = F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x)
    return left.join(right, ["label", "d", "c0", "c1"]).where((F.col("a") <= F.col("b")) & (apart <= far)).select("a", "b").distinct()


def compare(x, y, threshold: float, same: bool):
    """Indices of the rows of x and y (unit vectors on principal axes) with a cosine of at least the threshold; i < j if they are the same."""
    import numpy as np

    d, at = x.shape[1], min(BLOCKS[0], x.shape[1])
    least = threshold - _SLACK
    suffix = lambda z, k: np.sqrt(np.maximum((z[:, k:] ** 2).sum(1), 0))
    s = x[:, :at] @ y[:, :at].T
    alive = s + np.outer(suffix(x, at), suffix(y, at)) >= least
    if same:
        alive &= np.tri(len(x), dtype=bool).T & ~np.eye(len(x), dtype=bool)
    i, j = np.nonzero(alive)
    p = s[i, j]
    for step in (*BLOCKS[1:], d):
        if not len(i) or at >= d:
            break
        to = min(d, at + step)
        if len(i) * 8 > s.size:  # many are left: whole tiles are faster
            p = p + (x[:, at:to] @ y[:, at:to].T)[i, j]
        else:
            p = p + np.einsum("nk,nk->n", x[i, at:to], y[j, at:to])
        at = to
        ok = p + suffix(x, at)[i] * suffix(y, at)[j] >= least
        i, j, p = i[ok], j[ok], p[ok]
    return i, j, p


def linked(tiles: DataFrame, pairs: DataFrame, axes: dict, threshold: float) -> DataFrame:
    """rep, links (with multiplicities), root (of a spanning forest) for each tile pair and vector with links there."""
    import pyarrow as pa

    group = lambda c: F.floor(F.col(c) / GROUP).cast("long")
    on = pairs.select(group("a").alias("ga"), group("b").alias("gb"), "a", "b")
    # each tile once a pair of groups, with the tiles that it is to be compared with
    first = on.groupBy("ga", "gb", F.col("a").alias("tile")).agg(F.collect_list("b").alias("bs"))
    second = on.select("ga", "gb", F.col("b").alias("tile")).distinct().withColumn("bs", F.array().cast("array<long>"))
    wanted = first.unionByName(second).groupBy("ga", "gb", "tile").agg(F.flatten(F.collect_list("bs")).alias("bs"))
    both = wanted.join(tiles.select("tile", "d", "ids", "mults", "vectors"), "tile")
    none = pa.schema([("rep", pa.int64()), ("links", pa.int64()), ("root", pa.int64())])

    def run(table):
        import numpy as np

        rows = {r["tile"]: r for r in table.to_pylist()}
        for r in rows.values():
            r["v"] = np.frombuffer(r.pop("vectors")).reshape(-1, r["d"])
            r["x"] = unit(r["v"]) @ axes[r["d"]]
        out = []
        for a_ in sorted(rows):
            for b_ in sorted(rows[a_]["bs"]):
                p, q = rows[a_], rows[b_]
                found = forest(compare(p["x"], q["x"], threshold, a_ == b_), p, q, a_ == b_)
                if found:
                    out.append(found)
        return pa.concat_tables(out) if out else none.empty_table()

    def unit(v):
        import numpy as np

        u = v / np.abs(v).max(1, keepdims=True)
        return u / np.sqrt((u * u).sum(1, keepdims=True))

    def forest(found, a, b, same):
        import numpy as np

        i, j, p = found
        near = np.flatnonzero(np.abs(p - threshold) <= 2 * _SLACK)
        if len(near):  # rotation rounds; these are settled by the vectors as they are
            p = p.copy()
            p[near] = np.einsum("nk,nk->n", unit(a["v"][i[near]]), unit(b["v"][j[near]]))
        i, j = i[p >= threshold], j[p >= threshold]
        if not len(i):
            return None
        ids, mults = (np.frombuffer(q, "i8") for q in (a["ids"] + b["ids"], a["mults"] + b["mults"]))
        j = j + (0 if same else len(a["x"]))
        links = np.bincount(i, mults[j], len(ids)) + np.bincount(j, mults[i], len(ids))
        order = np.argsort(ids, kind="stable")
        rank = np.empty(len(ids), "i8")
        rank[order] = np.arange(len(ids))
        label = rank.copy()
        while True:
            new = label.copy()
            np.minimum.at(new, i, label[j])
            np.minimum.at(new, j, label[i])
            new = np.minimum(new, new[order[new]])
            if (new == label).all():
                break
            label = new
        root, on = ids[order[label]], np.flatnonzero(links)
        return pa.table([pa.array(ids[on]), pa.array(links[on].astype("i8")), pa.array(root[on])], schema=none)

    return both.groupBy("ga", "gb").applyInArrow(run, "rep long, links long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, tile: int = TILE) -> DataFrame:
    """vec_id, n_links, component_id, kept of vectors (vec_id, embedding, label)."""
    bound_batches(vectors.sparkSession)
    base = materialize(vectors.select("vec_id", "label", "embedding").distinct().withColumn("valid", _valid()))
    classes = materialize(base.where("valid").groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult")))
    axes = principal_axes(classes)
    tiles = make_tiles(classes, axes, threshold, tile)
    found = materialize(linked(tiles, tile_pairs(tiles, threshold), axes, threshold))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    comps = components(found, "rep", "root")
    own = classes.select("label", "embedding", "rep", "mult").join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    own = own.select("label", "embedding", (F.col("mult") - 1 + F.coalesce("links", F.lit(0))).alias("n"), F.coalesce("component", "rep").alias("c"))
    out = base.where("valid").join(own, ["label", "embedding"]).select("vec_id", F.col("n").cast("long").alias("n_links"), F.col("c").alias("component_id"))
    rest = base.where("not valid").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return out.unionByName(rest).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH RECURSIVE v AS (SELECT DISTINCT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(e) > 0
  AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  AND list_cosine_similarity(a.e, b.e) >= {THRESHOLD}),
r AS (SELECT vec_id AS a, vec_id AS b FROM ok UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a),
c AS (SELECT a, min(b) AS c FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM p GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.c, v.vec_id) AS component_id,
  v.vec_id IS NOT DISTINCT FROM coalesce(c.c, v.vec_id) AS kept
FROM v LEFT JOIN n ON n.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
