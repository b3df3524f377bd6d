"""Validation of a whole published network: candidates, metadata, decisions, trails and segments against each other.

Tables are flat but for provenance, which a published row carries as a struct. A trail's segments, ids and keys are short
arrays. All checks are equi-joins on keys and predicates on rows, and nothing is gathered but one row of flags.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geo import LINE, line_length
from ..functions.keys import SEGMENT_KEY_VERSION, TRAIL_KEY_VERSION, candidate_trail_key, trail_key
from ..functions.numbers import approx_equal, finite
from .issues import Rule, duplicates, every, issues
from .publication import VERIFIED, segment_key

#: The version of the network, and the regions that a trail may lie in.
NETWORK_VERSION = "publication-v1"
REGIONS = ("Franconia-Pemigewasset", "Presidential Range", "Carter-Moriah", "Sandwich Range", "Waterville Valley", "Other")

ARTIFACT = "struct<generated_at:string,demo_only:boolean,algorithm_version:string>"
DECISION = "struct<target_type:string,target_key:string,decision:string,review_timestamp:string,notes:string>"
#: What a candidate segment and its source, the segment that was built, have in common.
SOURCE = f"struct<segment_key:string,display_name:string,item_key:string,normalized:string,provider:string,ids:array<string>,start_key:string,end_key:string,line:{LINE},miles:double,metres:double,lineage:string,modification:string>"


@dataclass(frozen=True)
class Network:
    """The tables of a publication. Keys: candidate_trail_key, segment_key, trail_id, segment_id.

    header: one row of algorithm_version, trail_key_version, segment_key_version, demo_only, source and
    decision_source (ARTIFACT). candidate_trails: candidate_trail_key, display_name, region, item_key, normalized,
    provider, ids, segment_keys, miles. candidate_segments: the fields of SOURCE, candidate_trail_key, version, artifact
    (ARTIFACT), source (SOURCE). metadata: candidate_trail_key, display_name, region. decisions: the fields of DECISION.
    trails: trail_id, trail_key, slug, name, region, normalized, data_status, verification_status, ids, miles,
    provenance (candidate_trail_key, item_key, provider, segment_keys, decision). segments: segment_id, production_key,
    slug, trail_id, trail_key, trail_name, region, data_status, verification_status, completed, provider, ids, line,
    miles, provenance (segment_key, candidate_trail_key, item_key, start_key, end_key, version, artifact, source, lineage,
    decision, trail_decision, upstream of segment, start and end decision).
    """

    header: DataFrame
    candidate_trails: DataFrame
    candidate_segments: DataFrame
    metadata: DataFrame
    decisions: DataFrame
    trails: DataFrame
    segments: DataFrame


def _blank(c: Column) -> Column:
    return F.length(F.trim(F.coalesce(c, F.lit("")))) == 0


def _same_set(a: Column, b: Column) -> Column:
    """Equal with repeats but for the order; a missing array equals none."""
    return F.coalesce(F.sort_array(a) == F.sort_array(b), F.lit(False))


def _near(tolerance: float = 1e-6):
    return lambda a, b: F.coalesce(approx_equal(a, b, tolerance), F.lit(False))


def _bad_time(c: Column) -> Column:
    return _blank(c) | F.try_to_timestamp(c).isNull()


def _one(df: DataFrame, key: str, name: str) -> DataFrame:
    """key and one row of each key as a struct; of rows that share a key the greatest, so that joins repeat no row."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*df.columns)).alias(name))


def _decided(decisions: DataFrame, kind: str, key: str, name: str) -> DataFrame:
    rows = decisions.where(F.col("target_type") == kind)
    return _one(rows.select(*[F.col(c) for c in ("target_type", "target_key", "decision", "review_timestamp", "notes")]), "target_key", name).withColumnsRenamed({"target_key": key})


class _Rules(list[Rule]):
    """Rules whose messages end in the key of the row."""

    def __init__(self, prefix: str, key: Column) -> None:
        super().__init__()
        self.prefix, self.key = prefix, F.coalesce(key.cast("string"), F.lit(""))

    def wrong(self, name: str, bad: Column) -> None:
        name = f"{self.prefix}_{name}"
        self.append((name, bad, F.concat(F.lit(f"{name}:"), self.key)))

    def agree(self, there: Column, pairs: dict[str, tuple[Column, Column]], name: str) -> None:
        """Where the other row is ``there``: both columns of each pair are equal, null to null, or as their type wants it."""
        how = {"ids": _same_set, "segment_keys": _same_set, "miles": _near(), "metres": _near(0.001)}
        for field, (a, b) in pairs.items():
            same = how.get(field, Column.eqNullSafe)
            self.wrong(f"{name}_{field}", there & ~same(a, b))


def _binding(rules: _Rules, source: Column, candidate: Column, name: str) -> None:
    """The segment that was built against the candidate made of it, field by field; its own lineage comes from the candidate's source."""
    rules.wrong(f"{name}_missing", source.isNull())
    fields = ("segment_key", "item_key", "display_name", "normalized", "start_key", "end_key", "line", "miles", "metres", "ids", "provider")
    of = {f: (source[f], candidate[f]) for f in fields} | {f: (source[f], candidate["source"][f]) for f in ("lineage", "modification")}
    rules.agree(source.isNotNull() & candidate.isNotNull(), of, name)


def _coordinates(rules: _Rules, line: Column) -> None:
    some = lambda bad: F.coalesce(F.exists(line, bad), F.lit(False))
    number = lambda v: F.coalesce(finite(v), F.lit(False))
    rules.wrong("line_malformed", line.isNull() | (F.size(line) < 2))
    rules.wrong("place_missing", some(lambda p: p.isNull() | p["lon"].isNull() | p["lat"].isNull()))
    rules.wrong("place_not_finite", some(lambda p: p["lon"].isNotNull() & p["lat"].isNotNull() & ~(number(p["lon"]) & number(p["lat"]))))
    rules.wrong("longitude_out_of_range", some(lambda p: number(p["lon"]) & (F.abs(p["lon"]) > 180)))
    rules.wrong("latitude_out_of_range", some(lambda p: number(p["lat"]) & (F.abs(p["lat"]) > 90)))
    rules.wrong("no_length", (F.size(line) >= 2) & (line_length(line) <= 0))


def _positive(miles: Column) -> Column:
    return F.coalesce(finite(miles) & (miles > 0), F.lit(False))


def header_issues(n: Network) -> DataFrame:
    """Versions of the network and its keys, both identities of the source, and that demo and private parts don't mix."""
    h = _Rules("header", F.lit(""))
    for c, want in (("algorithm_version", NETWORK_VERSION), ("trail_key_version", TRAIL_KEY_VERSION), ("segment_key_version", SEGMENT_KEY_VERSION)):
        h.wrong(c, ~F.col(c).eqNullSafe(F.lit(want)))
    h.wrong("demo_only_missing", F.col("demo_only").isNull())
    whole = {}
    for name in ("source", "decision_source"):
        s = F.col(name)
        h.wrong(f"{name}_missing", s.isNull())
        gaps = {"generated_at": _blank(s["generated_at"]), "demo_only": s["demo_only"].isNull(), "algorithm_version": _blank(s["algorithm_version"])}
        for field, gap in gaps.items():
            h.wrong(f"{name}_{field}", s.isNotNull() & gap)
        whole[name] = s.isNotNull() & ~(gaps["generated_at"] | gaps["demo_only"] | gaps["algorithm_version"])
    h.wrong("sources_differ", whole["source"] & whole["decision_source"] & (F.col("source") != F.col("decision_source")))
    flags = n.header.select(F.explode(F.array("demo_only", "source.demo_only", "decision_source.demo_only")).alias("d")).unionByName(n.candidate_segments.select(F.col("artifact.demo_only").alias("d"))).unionByName(n.segments.select(F.col("provenance.artifact.demo_only").alias("d")))
    mixed = flags.agg(F.min("d").alias("a"), F.max("d").alias("b")).where("a <> b").select(F.lit("demo_mixed").alias("rule"), F.lit("demo_mixed:").alias("message"))
    return every(issues(n.header, h), mixed)


def key_issues(n: Network) -> DataFrame:
    """Keys that are blank or shared by several rows; a table is read once for its blanks and once for all its keys."""
    tables = [
        (n.candidate_trails, ["candidate_trail_key"], "candidate_trail"),
        (n.candidate_segments, ["segment_key"], "candidate_segment"),
        (n.metadata, ["candidate_trail_key"], "metadata"),
        (n.trails, ["trail_id", "trail_key", "slug"], "trail"),
        (n.segments, ["segment_id", "production_key", "slug"], "segment"),
    ]
    out = []
    for df, keys, name in tables:
        blank = _Rules(name, F.lit(""))
        for c in keys:
            blank.wrong(f"missing_{c}", _blank(F.col(c)))
        one = F.explode(F.array(*[F.struct(F.lit(f"{name}_duplicate_{c}").alias("rule"), F.col(c).cast("string").alias("key")) for c in keys])).alias("x")
        shared = df.select(one).select("x.*").where(~_blank(F.col("key"))).groupBy("rule", "key").count().where("count > 1")
        out += [issues(df, blank), shared.select("rule", F.concat("rule", F.lit(":"), "key").alias("message"))]
    return every(*out, duplicates(n.decisions, ["target_type", "target_key"], "decision_duplicate"))


def candidate_issues(n: Network, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """Metadata and candidate trails against each other, candidate segments against their trail, source and artifact."""
    trails, meta = _one(n.candidate_trails, "candidate_trail_key", "trail"), _one(n.metadata, "candidate_trail_key", "meta")
    key, t, m = F.col("candidate_trail_key"), F.col("trail"), F.col("meta")
    of_meta = _Rules("metadata", key)
    of_meta.wrong("trail_unknown", t.isNull())
    of_meta.wrong("region_invalid", ~F.coalesce(F.col("region").isin(*regions), F.lit(False)))

    c = _Rules("candidate_trail", key)
    c.wrong("metadata_missing", m.isNull())
    c.agree(m.isNotNull(), {f: (F.col(f), m[f]) for f in ("display_name", "region")}, "metadata")
    for f in ("item_key", "normalized", "provider"):
        c.wrong(f"{f}_missing", _blank(F.col(f)))
    for f in ("ids", "segment_keys"):
        c.wrong(f"{f}_missing", F.coalesce(F.size(f), F.lit(0)) < 1)
    c.wrong("miles_invalid", ~_positive(F.col("miles")))

    s = _Rules("candidate_segment", F.col("segment_key"))
    s.wrong("trail_unknown", t.isNull())
    s.agree(t.isNotNull(), {f: (F.col(f), t[f]) for f in ("item_key", "normalized", "provider")}, "trail")
    canonical = F.col("canonical")
    s.wrong("artifact_differs", canonical.isNotNull() & ~F.col("artifact").eqNullSafe(canonical))
    own = n.candidate_segments.withColumn("candidate", F.struct(*n.candidate_segments.columns))
    _binding(s, F.col("source"), F.col("candidate"), "source")
    header = n.header.limit(1).select(F.when(~(_blank(F.col("source.generated_at")) | F.col("source.demo_only").isNull() | _blank(F.col("source.algorithm_version"))), F.col("source")).alias("canonical"))
    return every(
        issues(n.metadata.join(trails, "candidate_trail_key", "left"), of_meta),
        issues(n.candidate_trails.join(meta, "candidate_trail_key", "left"), c),
        issues(own.join(trails, "candidate_trail_key", "left").join(F.broadcast(header), how="left"), s),
    )


def decision_issues(n: Network) -> DataFrame:
    """Decisions need a time that can be read and a target that is there; what was turned down must not be published."""
    d = n.decisions.withColumn("key", F.concat_ws(":", "target_type", "target_key"))
    r = _Rules("decision", F.col("key"))
    r.wrong("timestamp_invalid", _bad_time(F.col("review_timestamp")))
    targets = n.candidate_trails.select(F.lit("trail").alias("target_type"), F.col("candidate_trail_key").alias("target_key")).unionByName(n.candidate_segments.select(F.lit("segment").alias("target_type"), F.col("segment_key").alias("target_key"))).distinct().withColumn("known", F.lit(True))
    out = n.trails.select(F.lit("trail").alias("target_type"), F.col("provenance.candidate_trail_key").alias("target_key")).unionByName(n.segments.select(F.lit("segment").alias("target_type"), F.col("provenance.segment_key").alias("target_key"))).distinct().withColumn("published", F.lit(True))
    for kind in ("trail", "segment"):
        r.wrong(f"{kind}_unknown", (F.col("target_type") == kind) & F.col("known").isNull())
    r.wrong("published_despite", F.col("decision").isin("rejected", "needs_review") & F.col("published"))
    return issues(d.join(targets, ["target_type", "target_key"], "left").join(out, ["target_type", "target_key"], "left"), r)


def trail_issues(n: Network, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """Published trails against their candidate, its metadata and the decision about it."""
    p, c, m, d = (F.col(x) for x in ("provenance", "candidate", "meta", "decided"))
    x = n.trails.withColumn("candidate_trail_key", p["candidate_trail_key"])
    x = x.join(_one(n.candidate_trails, "candidate_trail_key", "candidate"), "candidate_trail_key", "left")
    x = x.join(_one(n.metadata, "candidate_trail_key", "meta"), "candidate_trail_key", "left").join(_decided(n.decisions, "trail", "candidate_trail_key", "decided"), "candidate_trail_key", "left")
    r = _Rules("trail", F.col("trail_id"))
    r.wrong("data_status", ~F.col("data_status").eqNullSafe(F.lit("verified")))
    r.wrong("verification_status", ~F.col("verification_status").eqNullSafe(F.lit("human_verified")))
    r.wrong("provenance_missing", p.isNull())
    r.wrong("candidate_unknown", c.isNull())
    known = c.isNotNull()  # without a candidate there is nothing more to compare
    r.wrong("metadata_missing", known & m.isNull())
    r.agree(known & m.isNotNull(), {"display_name": (F.col("name"), m["display_name"]), "region": (F.col("region"), m["region"])}, "metadata")
    r.wrong("region_invalid", known & ~F.coalesce(F.col("region").isin(*regions), F.lit(False)))
    r.agree(known, {"normalized": (F.col("normalized"), c["normalized"]), "ids": (F.col("ids"), c["ids"]), "miles": (F.col("miles"), c["miles"])}, "candidate")
    r.agree(known, {f: (p[f], c[f]) for f in ("candidate_trail_key", "item_key", "provider", "segment_keys")}, "provenance")
    r.wrong("decision_missing", known & d.isNull())
    r.wrong("decision_not_verified", known & ~d["decision"].eqNullSafe(F.lit(VERIFIED)))
    r.wrong("decision_differs", known & d.isNotNull() & ~p["decision"].eqNullSafe(d))
    r.wrong("trail_key_unstable", known & ~F.col("trail_key").eqNullSafe(trail_key(candidate_trail_key(c["item_key"], c["normalized"]))))
    return issues(x, r)


def segment_issues(n: Network) -> DataFrame:
    """Published segments against their trail, their candidate, the decisions about both and those made upstream."""
    p, c, t, d, dt = (F.col(x) for x in ("provenance", "candidate", "trail", "decided", "trail_decided"))
    x = n.segments.withColumns({"_segment": p["segment_key"], "_trail": p["candidate_trail_key"]})
    x = x.join(_one(n.candidate_segments, "segment_key", "candidate").withColumnsRenamed({"segment_key": "_segment"}), "_segment", "left")
    x = x.join(_one(n.trails, "trail_id", "trail"), "trail_id", "left").join(n.trails.select("trail_key").distinct().withColumn("has_key", F.lit(True)), "trail_key", "left")
    x = x.join(_decided(n.decisions, "segment", "_segment", "decided"), "_segment", "left").join(_decided(n.decisions, "trail", "_trail", "trail_decided"), "_trail", "left")
    r = _Rules("segment", F.col("segment_id"))
    r.wrong("data_status", ~F.col("data_status").eqNullSafe(F.lit("verified")))
    r.wrong("verification_status", ~F.col("verification_status").eqNullSafe(F.lit("human_verified")))
    r.wrong("completed", ~F.col("completed").eqNullSafe(F.lit(False)))
    r.wrong("trail_unknown", t.isNull())
    r.wrong("trail_key_unknown", F.col("has_key").isNull())
    r.agree(t.isNotNull(), {"trail_key": (F.col("trail_key"), t["trail_key"]), "trail_name": (F.col("trail_name"), t["name"]), "region": (F.col("region"), t["region"]), "candidate_trail_key": (F.coalesce(c["candidate_trail_key"], t["provenance"]["candidate_trail_key"]), t["provenance"]["candidate_trail_key"])}, "trail")
    r.wrong("candidate_unknown", c.isNull())
    known = c.isNotNull()
    r.agree(known, {f: (p[f], c[f]) for f in ("segment_key", "candidate_trail_key", "item_key", "start_key", "end_key", "version", "artifact")}, "provenance")
    r.agree(known, {f: (F.col(f), c[f]) for f in ("provider", "ids", "line", "miles")}, "candidate")
    r.wrong("provenance_lineage", known & ~p["lineage"].eqNullSafe(c["source"]["lineage"]))
    _binding(r, p["source"], c, "source")
    r.wrong("production_key_unstable", known & t.isNotNull() & ~F.col("production_key").eqNullSafe(segment_key(F.col("trail_key"), c["line"])))
    _coordinates(r, F.col("line"))
    r.wrong("miles_invalid", ~_positive(F.col("miles")))
    for name, made, kept in (("decision", d, p["decision"]), ("trail_decision", dt, p["trail_decision"])):
        r.wrong(f"{name}_not_verified", ~made["decision"].eqNullSafe(F.lit(VERIFIED)))
        r.wrong(f"{name}_differs", made.isNotNull() & ~kept.eqNullSafe(made))
    r.wrong("timestamp_invalid", _bad_time(p["decision"]["review_timestamp"]))
    for name, kind, target in (("segment", "segment", "segment_key"), ("start", "junction", "start_key"), ("end", "junction", "end_key")):
        u = p["upstream"][name]
        r.wrong(f"upstream_{name}_not_accepted", ~(u["target_type"].eqNullSafe(F.lit(kind)) & u["decision"].eqNullSafe(F.lit("accepted"))))
        r.wrong(f"upstream_{name}_target", known & ~u["target_key"].eqNullSafe(c[target]))
    a = p["artifact"]
    r.wrong("artifact_missing", _blank(a["generated_at"]) | a["demo_only"].isNull() | _blank(a["algorithm_version"]))
    return issues(x, r)


def network_issues(n: Network, regions: tuple[str, ...] = REGIONS) -> DataFrame:
    """rule, message of everything wrong with a network; no row means that it may be loaded. Empty tables give no row."""
    return every(header_issues(n), key_issues(n), candidate_issues(n, regions), decision_issues(n), trail_issues(n, regions), segment_issues(n))
