"""Nearest place of a trace to each sample of a segment: boxes of stretches bound the distance, only what may win is measured."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import DEGREE, EARTH, distance, point
from .graph import checkpoint
from .traces import trusted_lines

#: Metres by which bounds are relaxed: values are rounded to millimetres before they are compared.
SLACK = 0.002


def _finite(*values: Column) -> Column:
    """Whether no value is null, NaN or infinite."""
    ok = F.lit(True)
    for v in values:
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    return ok


def stretches(points: DataFrame, longest: float, size: int = 256) -> DataFrame:
    """A row for each ``size`` consecutive points of a component: their places, their edges' far ends (NaN where none is trusted), a box."""
    w = Window.partitionBy("activity_key", "component_idx").orderBy("point_idx")
    far = lambda c: F.when(F.col("gap") <= longest, F.col("b")[c]).otherwise(F.lit(float("nan")))
    known = trusted_lines(points, longest).where(_finite(F.col("lon"), F.col("lat")))
    p = known.select("activity_key", "component_idx", F.floor((F.row_number().over(w) - 1) / size).cast("int").alias("part"), F.struct(F.col("point_idx").cast("long").alias("i"), F.col("line_idx").cast("long").alias("line"), F.col("a.lon").alias("lon"), F.col("a.lat").alias("lat"), far("lon").alias("to_lon"), far("lat").alias("to_lat")).alias("p"))
    reach = lambda c: F.when(F.isnan(F.col(f"p.to_{c}")), F.col(f"p.{c}")).otherwise(F.col(f"p.to_{c}"))
    edge = lambda f, pick, c: f(pick(F.col(f"p.{c}"), reach(c)))
    g = p.groupBy("activity_key", "component_idx", "part").agg(
        F.sort_array(F.collect_list("p")).alias("p"),
        F.struct(edge(F.min, F.least, "lon").alias("x1"), edge(F.min, F.least, "lat").alias("y1"), edge(F.max, F.greatest, "lon").alias("x2"), edge(F.max, F.greatest, "lat").alias("y2")).alias("box"),
    )
    # a component's last part has its number of parts less one
    return g.withColumn("parts", F.max("part").over(Window.partitionBy("activity_key", "component_idx")) + 1)


def blocks(samples: DataFrame, size: int = 64) -> DataFrame:
    """A row for each ``size`` consecutive samples of a segment: their numbers and places, one of them as middle, and how far the others are from it."""
    s = samples.select("segment_key", F.floor(F.col("sample_idx") / size).cast("int").alias("block"), F.struct(F.col("sample_idx").cast("long").alias("i"), F.col("place.lon").alias("lon"), F.col("place.lat").alias("lat")).alias("s"))
    b = s.groupBy("segment_key", "block").agg(F.sort_array(F.collect_list("s")).alias("s"))
    b = b.withColumn("middle", F.element_at("s", F.floor(F.size("s") / 2).cast("int") + 1))
    return b.withColumn("radius", F.array_max(F.transform("s", lambda x: distance(x, F.col("middle")))))


def box_bound(p: Column, box: Column) -> Column:
    """Metres that no place of the box is nearer to p than."""
    short = lambda v, lo, hi: F.greatest(lo - v, v - hi, F.lit(0.0))
    dy = F.radians(short(p["lat"], box["y1"], box["y2"])) / 2
    side = lambda lon: F.pow(F.sin(F.radians(p["lon"] - lon) / 2), 2)
    dx = F.when(p["lon"].between(box["x1"], box["x2"]), F.lit(0.0)).otherwise(F.least(side(box["x1"]), side(box["x2"])))
    far = F.greatest(F.abs(box["y1"]), F.abs(box["y2"]))
    h = F.pow(F.sin(dy), 2) + F.cos(F.radians(p["lat"])) * F.cos(F.radians(far)) * dx
    return 2 * EARTH * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def _metres(lon1, lat1, lon2, lat2):
    h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
    return 2 * EARTH * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _bound(lon, lat, x1, y1, x2, y2):
    dy = np.radians(np.maximum(np.maximum(y1 - lat, lat - y2), 0.0)) / 2
    side = lambda x: np.sin(np.radians(lon - x) / 2) ** 2
    dx = np.where((lon >= x1) & (lon <= x2), 0.0, np.minimum(side(x1), side(x2)))
    h = np.sin(dy) ** 2 + np.cos(np.radians(lat)) * np.cos(np.radians(np.maximum(np.abs(y1), np.abs(y2)))) * dx
    return 2 * EARTH * np.arcsin(np.minimum(1.0, np.sqrt(h)))


def _on_edge(px, py, ax, ay, bx, by):
    """(metres, lon, lat) of the place on edge a-b nearest to p, in a plane about the mean of the three."""
    lon, lat = (px + ax + bx) / 3, (py + ay + by) / 3
    scale = DEGREE * np.cos(np.radians(lat))
    qx, qy, cx, cy, ex, ey = (px - lon) * scale, (py - lat) * DEGREE, (ax - lon) * scale, (ay - lat) * DEGREE, (bx - lon) * scale, (by - lat) * DEGREE
    dx, dy = ex - cx, ey - cy
    square = dx * dx + dy * dy
    with np.errstate(divide="ignore", invalid="ignore"):
        ratio = np.where(square == 0, 0.0, np.minimum(1.0, np.maximum(0.0, ((qx - cx) * dx + (qy - cy) * dy) / square)))
    x, y = (cx + dx * ratio) / scale + lon, (cy + dy * ratio) / DEGREE + lat
    return _metres(px, py, x, y), x, y


def _within(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(owner, place inside the owner) of each of ``counts`` things."""
    owner = np.repeat(np.arange(len(counts)), counts)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)


def search(s: dict[str, np.ndarray], s_at: np.ndarray, p: dict[str, np.ndarray], p_at: np.ndarray, chunk: int) -> dict[str, np.ndarray]:
    """For rows of samples s[s_at[i]:s_at[i + 1]] and points p[p_at[i]:p_at[i + 1]] each sample's winner.

    Winners are least by (value, kind, order, metres, point): an edge (kind 0) has its metres rounded to millimetres
    as value and its line as order, a point (kind 1) its metres and itself. Points go by chunks: first bounds of each
    chunk to each sample, then the chunks that may hold a winner, point by point.
    """
    n_s, n_p = np.diff(s_at), np.diff(p_at)
    n_c = -(-n_p // chunk)
    row, j = _within(n_c)
    begin = p_at[row] + j * chunk
    size = np.minimum(begin + chunk, p_at[row + 1]) - begin
    edge = ~np.isnan(p["to_lon"])
    to_lon, to_lat = np.where(edge, p["to_lon"], p["lon"]), np.where(edge, p["to_lat"], p["lat"])
    x1, y1 = (np.minimum.reduceat(np.minimum(a, b), begin) for a, b in ((p["lon"], to_lon), (p["lat"], to_lat)))
    x2, y2 = (np.maximum.reduceat(np.maximum(a, b), begin) for a, b in ((p["lon"], to_lon), (p["lat"], to_lat)))

    # samples times chunks, by sample
    of_row = np.repeat(np.arange(len(n_s)), n_s)
    sample, c = _within(n_c[of_row])
    c = c + (np.cumsum(n_c) - n_c)[of_row][sample]
    lon, lat, ends = s["lon"][sample], s["lat"][sample], begin[c] + size[c] - 1
    most = np.minimum(_metres(lon, lat, p["lon"][begin[c]], p["lat"][begin[c]]), _metres(lon, lat, p["lon"][ends], p["lat"][ends]))
    first = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])
    keep = _bound(lon, lat, x1[c], y1[c], x2[c], y2[c]) <= np.minimum.reduceat(most, first)[sample] + SLACK
    sample, c = sample[keep], c[keep]

    # samples times the points of those chunks
    pair, k = _within(size[c])
    sample, at = sample[pair], begin[c][pair] + k
    lon, lat = s["lon"][sample], s["lat"][sample]
    to_point = _metres(lon, lat, p["lon"][at], p["lat"][at])
    has = np.flatnonzero(edge[at])
    to_edge, ex, ey = np.full(len(at), np.inf), np.zeros(len(at)), np.zeros(len(at))
    to_edge[has], ex[has], ey[has] = _on_edge(lon[has], lat[has], p["lon"][at[has]], p["lat"][at[has]], p["to_lon"][at[has]], p["to_lat"][at[has]])
    rounded = np.floor(to_edge * 1000 + 0.5) / 1000
    first = np.flatnonzero(np.r_[True, sample[1:] != sample[:-1]])
    best = np.minimum.reduceat(np.minimum(rounded, to_point), first)[sample]
    by_edge, by_point = np.flatnonzero(rounded == best), np.flatnonzero(to_point == best)
    won = np.r_[by_edge, by_point]
    kind = np.r_[np.zeros(len(by_edge), np.int64), np.ones(len(by_point), np.int64)]
    order = np.where(kind == 0, p["line"][at[won]], p["i"][at[won]])
    metres = np.where(kind == 0, to_edge[won], to_point[won])
    place = np.lexsort((p["i"][at[won]], metres, order, kind, sample[won]))
    place = place[np.r_[True, np.diff(sample[won][place]) != 0]]
    won, kind = won[place], kind[place]
    here = at[won]
    return {
        "sample": sample[won],
        "value": best[won],
        "kind": kind,
        "order": order[place],
        "metres": metres[place],
        "point": p["i"][here],
        "lon": np.where(kind == 0, ex[won], p["lon"][here]),
        "lat": np.where(kind == 0, ey[won], p["lat"][here]),
    }


_MEET = ["activity_key", "slot"]
_FOUND = "activity_key string, segment_key string, component_idx int, sample_idx long, value double, kind long, o long, metres double, point long, lon double, lat double"


def refine(rows: DataFrame, chunk: int, most: int = 1 << 21) -> DataFrame:
    """Winners of rows (activity_key, segment_key, component_idx, s, p), at most ``most`` pairs of samples and points at once."""
    names = ("i", "lon", "lat"), ("i", "line", "lon", "lat", "to_lon", "to_lat")
    flat = rows.select("activity_key", "segment_key", F.col("component_idx").cast("int").alias("component_idx"), *[F.col(f"s.{c}").alias(f"s_{c}") for c in names[0]], *[F.col(f"p.{c}").alias(f"p_{c}") for c in names[1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if not whole.num_rows:
                continue
            pairs = np.cumsum(whole.column(3).value_lengths().to_numpy() * whole.column(6).value_lengths().to_numpy().astype(np.int64))
            cuts = np.unique(np.r_[0, np.searchsorted(pairs, np.arange(most, pairs[-1], most)), whole.num_rows])
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                b = whole.slice(lo, hi - lo)
                s = {c: b.column(3 + k).flatten().to_numpy() for k, c in enumerate(names[0])}
                p = {c: b.column(6 + k).flatten().to_numpy() for k, c in enumerate(names[1])}
                at = lambda col: np.r_[0, np.cumsum(col.value_lengths().to_numpy())].astype(np.int64)
                s_at = at(b.column(3))
                won = search(s, s_at, p, at(b.column(6)), chunk)
                row = pa.array(np.searchsorted(s_at, won["sample"], side="right") - 1)
                cols = [b.column(k).take(row) for k in range(3)] + [pa.array(s["i"][won["sample"]])] + [pa.array(won[c]) for c in ("value", "kind", "order", "metres", "point", "lon", "lat")]
                yield pa.RecordBatch.from_arrays(cols, ["activity_key", "segment_key", "component_idx", "sample_idx", "value", "kind", "o", "metres", "point", "lon", "lat"])

    return flat.mapInArrow(run, _FOUND)


def nearest(pair: DataFrame, samples: DataFrame, points: DataFrame, longest: float = 120.0, part: int = 256, block: int = 64, chunk: int = 16, slot_probes: int = 4096) -> DataFrame:
    """activity_key, segment_key, component_idx, sample_idx, distance, at: exact, for every sample of each pair and every component.

    ``pair`` is (activity_key, segment_key), ``samples`` (segment_key, sample_idx, place). Each trusted line's least
    distance is rounded to millimetres, points count after that unrounded, and the smallest is rounded again.

    Two levels of bounds: a component of many points lies in parts of ``part`` points, and a block of samples goes on
    only to parts whose box is no farther than the nearest part's own points; inside a part, each sample only to
    chunks of ``chunk`` points of which that is true. So a long trace is many rows, each bounded, and what a sample
    meets doesn't grow with the trace. Probes of an activity that has over ``slot_probes`` of them are dealt out. No radius is given up: the bounds are exact.
    """
    trace, block_rows = checkpoint(stretches(points, longest, part)), blocks(samples, block)  # the index, read three times
    probe = checkpoint(pair).select("activity_key", "segment_key").join(block_rows, "segment_key")
    # an activity that many segments meet is dealt to as many slots; the number of tasks is set, as few bytes here are much work
    tasks = int(probe.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slots = probe.groupBy("activity_key").agg(F.ceil(F.count("*") / slot_probes).cast("int").alias("slots"))
    deal = F.pmod(F.xxhash64("segment_key", "block"), F.col("slots")).cast("int")
    probe = probe.join(slots, "activity_key").withColumn("slot", deal).drop("slots").repartition(tasks, "activity_key", "slot")
    trace = trace.join(slots, "activity_key").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    short = refine(probe.join(trace.where("parts = 1").select(*_MEET, "component_idx", "p").hint("shuffle_hash"), _MEET), chunk)
    found = short.select("activity_key", "segment_key", "component_idx", "sample_idx", "value", "lon", "lat").unionByName(_of_parts(probe, trace.where("parts > 1"), block_rows, chunk))
    return found.select("activity_key", "segment_key", "component_idx", F.col("sample_idx").cast("int").alias("sample_idx"), (F.floor(F.col("value") * 1000 + 0.5) / 1000).alias("distance"), point(F.col("lon"), F.col("lat")).alias("at"))


def _of_parts(probe: DataFrame, long: DataFrame, block_rows: DataFrame, chunk: int) -> DataFrame:
    """Winners of components of several parts: bounds tell which parts a block of samples opens."""
    ends = [F.element_at("p", 1), F.element_at("p", -1)]
    bounds = probe.drop("s").join(long.select(*_MEET, "component_idx", "part", "box", *[e.alias(f"e{k}") for k, e in enumerate(ends)]), _MEET)
    middle = F.col("middle")
    bounds = bounds.select("activity_key", "segment_key", "block", "component_idx", "part", (box_bound(middle, F.col("box")) - F.col("radius")).alias("least"), (F.least(distance(middle, F.col("e0")), distance(middle, F.col("e1"))) + F.col("radius")).alias("most"))
    key = ["activity_key", "segment_key", "block", "component_idx"]
    reach = bounds.groupBy(*key).agg(F.min("most").alias("reach"))
    open_parts = bounds.join(reach, key).where(F.col("least") <= F.col("reach") + SLACK).select(*key, "part")
    rows = open_parts.join(long.where("slot = 0").select("activity_key", "component_idx", "part", "p"), ["activity_key", "component_idx", "part"]).join(block_rows.select("segment_key", "block", "s"), ["segment_key", "block"])
    order = F.struct("value", "kind", "o", "metres", "point", "lon", "lat")
    return refine(rows, chunk).groupBy("activity_key", "segment_key", "component_idx", "sample_idx").agg(F.min(order).alias("m")).select("activity_key", "segment_key", "component_idx", "sample_idx", "m.value", "m.lon", "m.lat")


def _measure(s: dict[str, np.ndarray], p: dict[str, np.ndarray], begin: np.ndarray, most: int) -> np.ndarray:
    """Millimetres of each sample (rows) to each component (columns) that begins at ``begin``; at most ``most`` pairs at once."""
    edge = np.flatnonzero(~np.isnan(p["to_lon"]))
    to = [p[c][edge] for c in ("lon", "lat", "to_lon", "to_lat")]
    out = np.empty((len(s["lon"]), len(begin)), np.int64)
    step = max(1, most // len(p["lon"]))
    for lo in range(0, len(out), step):
        x, y = s["lon"][lo : lo + step, None], s["lat"][lo : lo + step, None]
        value = _metres(x, y, p["lon"], p["lat"])
        if len(edge):
            value[:, edge] = np.minimum(value[:, edge], np.floor(_on_edge(x, y, *to)[0] * 1000 + 0.5) / 1000)
        out[lo : lo + step] = np.floor(np.minimum.reduceat(value, begin, axis=1) * 1000 + 0.5)
    return out


_PLACE = "struct<i:long,mm:long,component_idx:int,lon:double,lat:double>"
_MEASURED = f"activity_key string, segment_key string, block int, alone boolean, blocks int, i array<long>, component_idx array<int>, mm array<array<long>>, least array<long>, first {_PLACE}, last {_PLACE}"


def _lists(values: pa.Array, sizes: list[int]) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), values)


def _tables(rows: DataFrame, within: float, chunk: int, most: int = 1 << 16) -> DataFrame:
    """Rows of ``measured`` from rows (activity_key, alone, probes, components): all samples of a row against all its points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                yield measure(whole.slice(k, 1024))

    def measure(b: pa.RecordBatch) -> pa.RecordBatch:
        probes, components = b.column(2).flatten(), b.column(3).flatten()
        n_probes, n_components = (b.column(k).value_lengths().to_numpy() for k in (2, 3))
        segment, block, blocks, ss = probes.flatten()
        component, ps = components.flatten()
        component = component.to_numpy()
        s_all, p_all = ({f.name: c.to_numpy(zero_copy_only=False) for f, c in zip(x.type.value_type, x.flatten().flatten(), strict=True)} for x in (ss, ps))
        s_at, p_at = (np.r_[0, np.cumsum(x.value_lengths().to_numpy())].astype(np.int64) for x in (ss, ps))
        mm, least, i, named, sizes, counts = [], [], [], [], [], []
        sought: tuple[list[int], ...] = [], [], [], [], []  # probe, whether it is the last place, sample, component, millimetres
        probe = part = 0
        for here, parts in zip(n_probes.tolist(), n_components.tolist(), strict=True):
            at = s_at[probe : probe + here + 1]
            order = part + np.argsort(component[part : part + parts])
            points = np.concatenate([np.arange(p_at[c], p_at[c + 1]) for c in order])
            begin = np.cumsum(np.r_[0, (p_at[order + 1] - p_at[order])[:-1]])
            found = _measure({c: s_all[c][at[0] : at[-1]] for c in ("lon", "lat")}, {c: v[points] for c, v in p_all.items()}, begin, most)
            best = found.min(axis=1)
            covered = best / 1000 <= within
            for k in range(here):
                lo, hi = at[k] - at[0], at[k + 1] - at[0]
                mm.append(found[lo:hi].T.ravel())
                near = lo + np.flatnonzero(covered[lo:hi])
                for is_last, j in enumerate(near[[0, -1]] if len(near) else ()):
                    for out, v in zip(sought, (probe + k, is_last, at[0] + j, order[found[j].argmin()], best[j]), strict=True):
                        out.append(int(v))
            least.append(best)
            i.append(s_all["i"][at[0] : at[-1]])
            named += [component[order]] * here
            counts += [parts] * here
            sizes += np.diff(at).tolist()
            probe, part = probe + here, part + parts
        # the places of the first and last covered samples
        places: list[list[dict | None]] = [[None] * len(sizes) for _ in range(2)]
        if sought[0]:
            lists = [np.arange(p_at[c], p_at[c + 1]) for c in sought[3]]
            pick, to = np.array(sought[2]), np.concatenate(lists)
            won = search({c: v[pick] for c, v in s_all.items()}, np.arange(len(pick) + 1), {c: v[to] for c, v in p_all.items()}, np.r_[0, np.cumsum([len(x) for x in lists])], chunk)
            for (at_probe, is_last, j, c, value), lon, lat in zip(zip(*sought, strict=True), won["lon"], won["lat"], strict=True):
                places[is_last][at_probe] = {"i": int(s_all["i"][j]) * (-1 if is_last else 1), "mm": value, "component_idx": int(component[c]), "lon": float(lon), "lat": float(lat)}
        place = pa.struct([("i", pa.int64()), ("mm", pa.int64()), ("component_idx", pa.int32()), ("lon", pa.float64()), ("lat", pa.float64())])
        join = lambda x, kind: pa.array(np.concatenate(x) if x else np.zeros(0), kind)
        row = pa.array(np.repeat(np.arange(b.num_rows), n_probes))
        inner = _lists(join(mm, pa.int64()), np.repeat(sizes, counts).tolist())
        cols = [b.column(0).take(row), segment, block, b.column(1).take(row), blocks, _lists(join(i, pa.int64()), sizes), _lists(join(named, pa.int32()), counts), _lists(inner, counts), _lists(join(least, pa.int64()), sizes), pa.array(places[0], place), pa.array(places[1], place)]
        return pa.RecordBatch.from_arrays(cols, ["activity_key", "segment_key", "block", "alone", "blocks", "i", "component_idx", "mm", "least", "first", "last"])

    return rows.select("activity_key", "alone", "probes", "components").mapInArrow(run, _MEASURED)


def measured(pair: DataFrame, samples: DataFrame, points: DataFrame, within: float, longest: float = 120.0, part: int = 256, block: int = 64, chunk: int = 16, most_probes: int = 16, most_points: int = 256) -> DataFrame:
    """What ``nearest`` finds, in millimetres, in a row for each block of a pair's samples and bundle of the activity's components.

    activity_key, segment_key, block, of so many blocks of the segment; i (the samples' numbers); component_idx, mm (of
    each component a distance for each sample) and least, the smallest of each sample; first and last (i, mm,
    component_idx, lon, lat): the nearest place of the first and last sample within ``within``, of the last with its
    number negated, so that of several rows the least holds. A row is ``alone`` if it is all of its pair.

    An activity's probes and its components of one part lie in bundles of about ``most_probes`` and ``most_points``, so
    that samples and points go to a task once a bundle and not once for each pair of them. Components of several parts
    go by bounds, as in ``nearest``, and have rows of their own.
    """
    samples = samples.where(_finite(F.col("place.lon"), F.col("place.lat")))
    trace, block_rows = checkpoint(stretches(points, longest, part)), checkpoint(blocks(samples, block))
    pair = checkpoint(pair.select("activity_key", "segment_key"))
    tasks = int(pair.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    probe = pair.join(block_rows.select("segment_key", "block"), "segment_key")
    slots = checkpoint(probe.groupBy("activity_key").agg(F.ceil(F.count("*") / most_probes).cast("int").alias("slots")))
    deal = F.pmod(F.xxhash64("segment_key", "block"), F.col("slots")).cast("int")
    # the keys are dealt first, so that samples of few segments need not move
    probe = probe.join(slots, "activity_key").withColumn("slot", deal).drop("slots").repartition(tasks, *_MEET)
    of_segment = block_rows.groupBy("segment_key").agg(F.count("*").cast("int").alias("blocks"))
    probe = probe.join(block_rows, ["segment_key", "block"]).join(of_segment, "segment_key")

    sizes = trace.groupBy("activity_key").agg(F.ceil(F.sum(F.when(F.col("parts") == 1, F.size("p"))) / most_points).cast("int").alias("bundles"), F.max(F.col("parts") > 1).alias("long"))
    deal = F.pmod(F.xxhash64("component_idx"), F.col("bundles")).cast("int")
    bundle = trace.where("parts = 1").join(sizes, "activity_key").withColumn("bundle", deal)
    bundle = bundle.groupBy("activity_key", "bundle").agg(F.collect_list(F.struct(F.col("component_idx").cast("int").alias("component_idx"), "p")).alias("components"), F.first((F.col("bundles") == 1) & ~F.col("long")).alias("single"))
    bundle = bundle.join(slots, "activity_key").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    rows = probe.groupBy(*_MEET).agg(F.collect_list(F.struct("segment_key", "block", "blocks", "s")).alias("probes")).join(bundle, _MEET)
    # a pair is whole in a row if its activity is one bundle and its segment one block
    short = _tables(rows.withColumnRenamed("single", "alone"), within, chunk).withColumn("alone", F.col("alone") & (F.col("blocks") == 1))

    long = trace.where("parts > 1").join(slots, "activity_key").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("slots") - 1))).drop("slots")
    far = _of_parts(probe.drop("blocks"), long, block_rows, chunk).select("activity_key", "segment_key", F.col("component_idx").cast("int").alias("component_idx"), F.floor(F.col("sample_idx") / block).cast("int").alias("block"), F.struct(F.col("sample_idx").alias("i"), F.floor(F.col("value") * 1000 + 0.5).cast("long").alias("mm")).alias("x"), "lon", "lat")
    place = lambda sign: F.min(F.when(F.col("x.mm") / 1000 <= within, F.struct((sign * F.col("x.i")).alias("i"), F.col("x.mm").alias("mm"), F.col("component_idx").alias("component_idx"), "lon", "lat")))
    far = far.groupBy("activity_key", "segment_key", "component_idx", "block").agg(F.sort_array(F.collect_list("x")).alias("x"), place(1).alias("first"), place(-1).alias("last")).join(of_segment, "segment_key")
    far = far.select("activity_key", "segment_key", "block", F.lit(False).alias("alone"), "blocks", F.col("x.i").alias("i"), F.array("component_idx").alias("component_idx"), F.array(F.col("x.mm")).alias("mm"), F.col("x.mm").alias("least"), "first", "last")
    return short.unionByName(far)
