"""Ordered first fit in parallel: each place joins the first cluster that has a near member among the places before it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import EARTH, LINE, distance
from .graph import checkpoint, discard, written
from .spatial import place_pairs

#: Clusters of up to so many places are compared inside their row; larger ones by the corners of their hulls, in parts of numbers that agree but for so many bits.
SMALL, HULL_BITS = 16, 12
#: Items whose numbers agree but for so many bits are looked at in one task, in buffers of about so many rows.
BLOCK_BITS, BUFFER = 14, 1 << 18


def earlier_neighbours(items: DataFrame, tolerance: Column, cell: float) -> tuple[DataFrame, list[str]]:
    """(x, y): for each item and each near place the last earlier item y there, its own place included; and the paths of the tables read.

    ``items`` are (ord, kind, lon, lat); only items of one kind meet. Of the earlier items at one place the last one
    has the first cluster of them all, as it saw what they saw; so equal places cost their number, not its square.
    Places of one item each need no more than their order.
    """
    w = Window.partitionBy("kind", "lon", "lat").orderBy("ord")
    seen = items.select("ord", "kind", "lon", "lat", F.lag("ord").over(w).alias("y"), F.lead("ord").over(w).isNull().alias("last"), F.first("ord").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("place"))
    seen, seen_path = written(seen)
    same = seen.where("y is not null").select(F.col("ord").alias("x"), "y")
    places = seen.where("y is null").select("kind", F.col("ord").alias("id"), "lon", "lat", "last")
    near = place_pairs(places, tolerance, cell, ["kind"]).select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), (F.col("l_last") & F.col("r_last")).alias("one"))
    near, near_path = written(near)
    found = same.unionByName(near.where("one").select(F.greatest("a", "b").alias("x"), F.least("a", "b").alias("y")))
    near = near.where("not one")
    if near.isEmpty():
        return found, [seen_path, near_path]
    near = near.select("a", "b").unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b")))
    named = seen.select("ord", "place")
    seeks = near.join(named, near.a == named.place).select("a", "b", "ord", F.lit(None).cast(items.schema["ord"].dataType).alias("y"))
    gives = near.join(named, near.b == named.place).select("a", "b", "ord", F.col("ord").alias("y"))
    before = F.last("y", ignorenulls=True).over(Window.partitionBy("a", "b").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    met = seeks.unionByName(gives).withColumn("before", before).where("y is null and before is not null").select(F.col("ord").alias("x"), F.col("before").alias("y"))
    return found.unionByName(met), [seen_path, near_path]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, y, c) of a partition's rows (x, y), all of an item together and items in order; an item has a row without y, too.

    About BUFFER rows are looked at at once. An item is settled, with its beginning c and no y, if all that its paths lead
    to is among them; another has the least beginning known, or none, and rows with those y that are not settled here.
    """

    def settle(x: np.ndarray, y: pa.Array) -> pa.RecordBatch:
        own, item = np.unique(x, return_inverse=True)
        to, edge = y.fill_null(0).to_numpy(zero_copy_only=False), y.is_valid().to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(own, to), len(own) - 1)
        at = np.where(own[at] == to, at, -1)
        begins = np.ones(len(own), bool)
        begins[item[edge]] = False
        none = np.iinfo(np.int64).max
        c, open_ = np.where(begins, own, none).tolist(), [False] * len(own)
        for i, k in zip(item[edge].tolist(), at[edge].tolist(), strict=True):
            if k < 0:
                open_[i] = True
            else:
                open_[i] = open_[i] or open_[k]
                if c[k] < c[i]:
                    c[i] = c[k]
        c, left = np.array(c, np.int64), np.array(open_, bool)
        keep = edge & ((at < 0) | left[at])
        xs, ys = np.concatenate([own, x[keep]]), np.concatenate([np.zeros(len(own), np.int64), to[keep]])
        cs, row = np.concatenate([c, np.full(keep.sum(), none)]), np.arange(len(xs)) < len(own)
        open_rows = np.concatenate([left, np.ones(keep.sum(), bool)])
        return pa.RecordBatch.from_arrays([pa.array(xs), pa.array(ys, mask=row), pa.array(cs, mask=cs == none), pa.array(~open_rows)], ["x", "y", "c", "settled"])

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) < BUFFER:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        x = rows["x"].to_numpy()
        cut = int(np.searchsorted(x, x[-1]))  # the last item may go on in the next batch
        if cut:
            yield settle(x[:cut], rows["y"].slice(0, cut).combine_chunks())
        held = rows.slice(cut).to_batches()
    if sum(b.num_rows for b in held):
        rows = pa.Table.from_batches(held).combine_chunks()
        yield settle(rows["x"].to_numpy(), rows["y"].combine_chunks())


def first_fit(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(ord, first): the first item of each item's cluster; ``edges`` (x, y) lead to earlier items, all numbered by longs.

    An item without earlier neighbours begins a cluster; any other takes the first cluster of its neighbours, that is
    the least beginning that a path of edges leads to. Items whose paths stay among items of like numbers are settled in
    one pass. The others go through rounds: every item points to the neighbour with the least beginning known;
    beginnings are passed along all pointers by doubling, so a chain of n items takes log n steps; rounds end when no
    neighbour knows a lesser one. No step gathers a group in a task, and a step's table goes once the next one is written.
    """
    spark = items.sparkSession
    links = edges.select("x", "y").unionByName(items.select(F.col("ord").alias("x"), F.lit(None).cast("long").alias("y")))
    links = links.repartition(F.shiftright("x", BLOCK_BITS)).sortWithinPartitions("x")
    links = checkpoint(links.mapInArrow(_settle, "x long, y long, c long, settled boolean"))
    settled = links.where("settled").select(F.col("x").alias("ord"), F.col("c").alias("first"))
    left = links.where("not settled and y is null").select(F.col("x").alias("ord"), "c")
    if left.isEmpty():
        return settled
    known = links.where("settled").select(F.col("x").alias("y"), F.col("c").alias("k"))
    edges, edges_path = written(links.where("y is not null").select("x", "y").join(known, "y", "left"))
    least = edges.groupBy("x").agg(F.min(F.when(F.col("k").isNull(), F.col("y"))).alias("p"), F.min("k").alias("k"))
    edges = edges.where("k is null").select("x", "y")
    state, path = written(left.join(least, left.ord == least.x, "left").select("ord", F.coalesce("p", "ord").alias("p"), F.least("c", "k").alias("c")))
    while True:
        jumped = state
        while True:
            via = jumped.select(F.col("ord").alias("q"), F.col("p").alias("pp"), F.col("c").alias("pc"))
            step = jumped.join(via, F.col("p") == F.col("q")).select("ord", F.col("pp").alias("p"), F.least("c", "pc").alias("c"), (F.col("pp") != F.col("p")).alias("moved"))
            step, after = written(step)
            discard(spark, path)
            path = after
            jumped = step.drop("moved")
            if step.where("moved").isEmpty():
                break
        known = jumped.select("ord", "c")
        best = edges.join(known.select(F.col("ord").alias("y"), "c"), "y").groupBy("x").agg(F.min(F.struct("c", "y")).alias("m"))
        state, after = written(known.join(best, known.ord == best.x, "left").select("ord", F.coalesce("m.y", "ord").alias("p"), F.least("c", "m.c").alias("c"), (F.col("m.c") < F.col("c")).alias("better")))
        discard(spark, path)
        path = after
        if state.where("better").isEmpty():
            discard(spark, edges_path)
            return settled.unionByName(state.select("ord", F.col("c").alias("first")))
        state = state.drop("better")


def _hull(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    """Numbers of the places that are corners of the hull, by a projection that keeps great circles straight."""
    if len(lon) < 3:
        return np.arange(len(lon))
    x0, y0 = np.radians(lon[0]), np.radians(lat[0])
    dx, y = np.radians(lon) - x0, np.radians(lat)
    depth = np.sin(y0) * np.sin(y) + np.cos(y0) * np.cos(y) * np.cos(dx)
    if (depth <= 0.01).any():  # no such plane for places a quarter of the globe apart
        return np.arange(len(lon))
    px, py = np.cos(y) * np.sin(dx) / depth, (np.cos(y0) * np.sin(y) - np.sin(y0) * np.cos(y) * np.cos(dx)) / depth
    order = np.lexsort((py, px))
    keep: set[int] = set()
    for run in (order, order[::-1]):
        chain: list[int] = []
        for k in run:
            while len(chain) > 1 and (px[chain[-1]] - px[chain[-2]]) * (py[k] - py[chain[-2]]) - (py[chain[-1]] - py[chain[-2]]) * (px[k] - px[chain[-2]]) <= 0:
                chain.pop()
            chain.append(k)
        keep.update(chain)
    return np.array(sorted(keep))


def _diameter(lon: np.ndarray, lat: np.ndarray) -> float:
    most, x, y = 0.0, np.radians(lon), np.radians(lat)
    for lo in range(0, len(x), 512):
        a, b = x[lo : lo + 512, None], y[lo : lo + 512, None]
        h = np.sin((y - b) / 2) ** 2 + np.cos(b) * np.cos(y) * np.sin((x - a) / 2) ** 2
        most = max(most, float(2 * EARTH * np.arcsin(np.minimum(1.0, np.sqrt(h))).max()))
    return most


def _corners(groups: pa.Array) -> pa.Array:
    """The corners of the hull of each group of places; null of null."""
    return pa.array([None if g is None else [{"lon": x, "lat": y} for x, y in zip(*(v[_hull(*g)].tolist() for v in g), strict=True)] for g in _groups(groups)], groups.type)


def _widest(groups: pa.Array) -> pa.Array:
    """The greatest distance between two places of each group; null of null."""
    return pa.array([None if g is None else _diameter(*(v[_hull(*g)] for v in g)) for g in _groups(groups)], pa.float64())


def _groups(groups: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    flat, ends = groups.flatten(), np.cumsum(groups.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)).astype(int)
    lon, lat = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("lon", "lat"))
    for ok, lo, hi in zip(groups.is_valid().to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
        yield (lon[lo:hi], lat[lo:hi]) if ok else None


def spreads(placed: DataFrame) -> DataFrame:
    """(cluster, spread): the greatest distance between two of a cluster's places (cluster, ord, lon, lat).

    The two farthest places are corners of the hull, so a cluster's places of like numbers, 2^HULL_BITS at most, send on
    only their corners if they are many.
    """
    corners, widest, many = F.arrow_udf(_corners, LINE), F.arrow_udf(_widest, "double"), F.when(F.size("s") > SMALL, F.col("s"))
    pairs = F.flatten(F.transform("s", lambda a: F.transform("s", lambda b: distance(a, b))))
    parts = placed.groupBy("cluster", F.shiftright("ord", HULL_BITS).alias("part")).agg(F.collect_list(F.struct("lon", "lat")).alias("s"))
    whole = parts.select("cluster", F.coalesce(corners(many), "s").alias("s")).groupBy("cluster").agg(F.flatten(F.collect_list("s")).alias("s"))
    return whole.select("cluster", F.coalesce(widest(many), F.array_max(pairs)).alias("spread"))
