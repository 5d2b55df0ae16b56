"""Frame trees: validation, closure, paths and transform lookup over edge tables (parent, child, ...)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSE = ("tx", "ty", "tz", "qx", "qy", "qz", "qw")


def forest_faults(edges: DataFrame) -> DataFrame:
    """fault and frame: self edges, opposite edges, children of two parents, frames on a cycle."""
    e = edges.select("parent", "child").distinct()
    own = e.where("parent = child").select(F.lit("self edge").alias("fault"), F.col("child").alias("frame"))
    turned = e.select(F.col("child").alias("parent"), F.col("parent").alias("child"))
    opposite = e.where("parent <> child").join(turned, ["parent", "child"], "left_semi").select(F.lit("opposite edges").alias("fault"), F.col("child").alias("frame"))
    several = e.groupBy("child").agg(F.count("*").alias("n")).where("n > 1").select(F.lit("several parents").alias("fault"), F.col("child").alias("frame"))
    cyclic = e.join(_rooted(e), F.col("child") == F.col("frame"), "left_anti").select(F.lit("cycle").alias("fault"), F.col("child").alias("frame"))
    return own.union(opposite).union(several).union(cyclic).distinct()


def _roots(e: DataFrame) -> DataFrame:
    return e.select(F.col("parent").alias("root")).distinct().join(e.select(F.col("child").alias("root")).distinct(), "root", "left_anti")


def _rooted(e: DataFrame) -> DataFrame:
    """Frames that can be reached from a root, by walks of doubling length, until none is new."""
    out = _roots(e).select(F.col("root").alias("frame")).checkpoint()
    step = e.select(F.col("parent").alias("a"), F.col("child").alias("b"))
    while True:
        new = out.join(step, F.col("frame") == F.col("a")).select(F.col("b").alias("frame")).distinct().join(out, "frame", "left_anti").checkpoint()
        if new.isEmpty():
            return out
        out = out.union(new)
        step = step.join(step.select(F.col("a").alias("b"), F.col("b").alias("c")), "b").select("a", F.col("c").alias("b")).distinct().checkpoint()


def closure(edges: DataFrame) -> DataFrame:
    """root, descendant, depth and path of every frame below a root (a parent that is no child), however deep.

    Each round joins the paths found with segments of twice the length before; a
    path holds no frame twice, so the rounds end. `path` is joined by slashes,
    which frames may hold themselves.
    """
    e = edges.select("parent", "child").distinct()
    out = _roots(e).select("root", F.col("root").alias("descendant"), F.array("root").alias("frames"))
    # segments of one length: the frame above, the last frame, and the frames below the first
    step = e.where("parent <> child").select(F.col("parent").alias("a"), F.col("child").alias("b"), F.array("child").alias("below"))
    apart = ~F.arrays_overlap("frames", "below")
    while True:
        new = out.join(step, F.col("descendant") == F.col("a")).where(apart).select("root", F.col("b").alias("descendant"), F.concat("frames", "below").alias("frames")).checkpoint()
        if new.isEmpty():
            return out.select("root", "descendant", (F.size("frames") - 1).alias("depth"), F.array_join("frames", "/").alias("path"))
        out = out.union(new)
        more = step.select(F.col("a").alias("b"), F.col("b").alias("c"), F.col("below").alias("more"))
        whole = step.join(more, "b").where(~F.arrays_overlap("below", "more") & ~F.array_contains("more", F.col("a")))
        step = whole.select("a", F.col("c").alias("b"), F.concat("below", "more").alias("below")).checkpoint()


def conflicts(edges: DataFrame) -> DataFrame:
    """Children that different topics hang under different parents, or as both static and moving."""
    by = edges.groupBy("child").agg(F.countDistinct("parent").alias("parents"), F.countDistinct("topic").alias("topics"), F.countDistinct("is_static").alias("kinds"))
    return by.where("topics > 1 AND (parents > 1 OR kinds > 1)").select("child", "parents", "kinds")


def latest(edges: DataFrame) -> DataFrame:
    """The last edge of each child of a topic, with the seq at which the child was first seen."""
    rest = [c for c in edges.columns if c not in ("topic", "child")]
    out = edges.groupBy("topic", "child").agg(F.max_by(F.struct(*rest), "seq").alias("v"), F.min("seq").alias("first_seq"))
    return out.select("topic", "child", "v.*", "first_seq")


def bad_values(edges: DataFrame) -> DataFrame:
    """Edges with empty names, values that are not finite, or a quaternion far from unit length, and why."""
    finite = F.lit(True)
    for c in POSE:
        finite = finite & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    n2 = sum((F.col(c) * F.col(c) for c in POSE[4:]), F.col("qx") * F.col("qx"))
    why = (
        F.when((F.coalesce("parent", F.lit("")) == "") | (F.coalesce("child", F.lit("")) == ""), "empty frame")
        .when(~F.coalesce(finite, F.lit(False)), "not finite")
        .when(n2 < 1e-12, "zero quaternion")
        .when(F.abs(n2 - 1) > 1e-6, "quaternion not of unit length")
    )
    return edges.withColumn("fault", why).where("fault IS NOT NULL")


def path_between(edges: DataFrame, ref: str, of: str) -> tuple[list[str], list[str]]:
    """Frames from `of` up to the common ancestor and from `ref` up to it.

    The distinct edges are made once; both walks go up a level with each look at
    them, to a root or to a frame that was met. Of several parents the first by name.
    """
    links = edges.groupBy("child").agg(F.min("parent").alias("parent")).checkpoint()
    ways = {f: [f] for f in (ref, of)}
    while True:
        heads = {way[-1] for way in ways.values()}
        above = {r["child"]: r["parent"] for r in links.where(F.col("child").isin(*heads)).collect()}  # two rows at most
        moved = [way for way in ways.values() if above.get(way[-1]) is not None and above[way[-1]] not in way]
        for way in moved:
            way.append(above[way[-1]])
        if not moved:
            break
    a, b = ways[ref], ways[of]
    common = next((f for f in b if f in a), None)
    if common is None:
        raise ValueError(f"no path between {ref!r} and {of!r}")
    return b[: b.index(common) + 1], a[: a.index(common) + 1]


def copied_static(source: DataFrame, target: DataFrame, start_ns: int) -> DataFrame:
    """The target's edges with the source's static ones in place of those for the same child, stamped with the start."""
    new = source.where("is_static").withColumn("stamp_ns", F.lit(start_ns))
    return target.join(new.select("child").distinct(), "child", "left_anti").unionByName(new)


def first_per_topic(messages: DataFrame) -> DataFrame:
    rest = [c for c in messages.columns if c != "topic"]
    return messages.groupBy("topic").agg(F.min_by(F.struct(*rest), "seq").alias("v")).select("topic", "v.*").select(*messages.columns)


def stamps_on_chain(edges: DataFrame, children: list[str]) -> DataFrame:
    """The distinct stamps of the moving edges of a chain."""
    return edges.where(F.col("child").isin(children) & ~F.col("is_static")).select("stamp_ns").distinct()


def pose(prefix: str = "") -> tuple[tuple[Column, ...], tuple[Column, ...]]:
    c = [F.col(f"{prefix}{k}") for k in POSE]
    return tuple(c[:3]), tuple(c[3:])


def _on_way(edges: DataFrame, steps: list[tuple[str, str]]) -> DataFrame:
    """The edges (child, parent) of a way, with their place on it."""
    place = F.lit(None).cast("int")
    for k, (child, parent) in enumerate(steps):
        place = F.when((F.col("child") == child) & (F.col("parent") == parent), k).otherwise(place)
    return edges.withColumn("_k", place).where("_k IS NOT NULL")


def sampled(stamps: DataFrame, edges: DataFrame, ref: str, of: str, way: tuple[list[str], list[str]] | None = None) -> DataFrame:
    """timestamp_ns, the pose of `of` in `ref`, reason and frame: a row for each stamp, with a pose or with why it has none.

    Static edges are as they last were; an edge is static if anything publishes it
    as such. Moving ones are interpolated. reason is "before the first transform"
    or "after the last transform", frame the child of the first edge, from `of` up
    and then down to `ref`, that has no transform there; null stamps go. All moving
    edges are looked up in one pass, keyed by their place on the way. Of transforms
    of one stamp the highest seq counts, where edges have one, for what comes after
    it, the lowest for what comes before. way: what `path_between` gave, where it is known.
    """
    from chronolane.functions import geometry as G
    from chronolane.operators import asof

    down, across = way or path_between(edges, ref, of)
    up = list(zip(down, down[1:], strict=False))
    back = list(zip(across, across[1:], strict=False))[::-1]
    own = _on_way(edges, up + back)
    still = F.when(F.col("is_static"), F.struct(F.col("stamp_ns"), *POSE))
    fixed = {r["_k"]: r["last"] for r in own.groupBy("_k").agg(F.max(still).alias("last")).collect()}  # a row for each edge of the way
    moving = [k for k in sorted(fixed) if fixed[k] is None]

    wanted = stamps.where("timestamp_ns IS NOT NULL").groupBy("timestamp_ns").agg(F.count("*").alias("_n"))
    if moving:
        asked = wanted.select("timestamp_ns", "_n", F.explode(F.array(*map(F.lit, moving))).alias("_k"))
        order = F.col("seq") if "seq" in edges.columns else F.col("stamp_ns")
        series = own.where(F.col("_k").isin(moving)).select("_k", F.col("stamp_ns").alias("timestamp_ns"), order.cast("long").alias("seq"), *POSE)
        found = asof.neighbours(asked, series, list(POSE), ["_k"])
        a, b, t = F.col("prev.timestamp_ns"), F.col("next.timestamp_ns"), F.col("timestamp_ns")
        f = F.when(a == b, 0.0).otherwise((t - a) / (b - a))
        (ta, qa), (tb, qb) = pose("prev."), pose("next.")
        values = [*[u + (v - u) * f for u, v in zip(ta, tb, strict=True)], *G.slerp(qa, qb, f)]
        why = F.when(F.col("prev").isNull(), "before the first transform").when(F.col("next").isNull(), "after the last transform")
        at = found.select("timestamp_ns", "_n", "_k", why.alias("_why"), F.struct(*[v.alias(c) for c, v in zip(POSE, values, strict=True)]).alias("_v"))
        failed = F.min(F.when(F.col("_why").isNotNull(), F.struct("_k", "_why")))
        wanted = at.groupBy("timestamp_ns", "_n").agg(failed.alias("_f"), *[F.first(F.when(F.col("_k") == k, F.col("_v")), ignorenulls=True).alias(f"_e{k}") for k in moving])
    else:
        wanted = wanted.withColumn("_f", F.lit(None).cast("struct<_k:int,_why:string>"))

    zero, one = F.lit(0.0), F.lit(1.0)
    mine = [f"_{c}" for c in POSE]
    out = wanted.select("*", *[(one if c == "_qw" else zero).alias(c) for c in mine])
    kept = out.columns[: -len(mine)]
    for k in range(len(up) + len(back)):
        t, q = pose(f"_e{k}.") if k in moving else (tuple(F.lit(float(fixed[k][c])) for c in POSE[:3]), tuple(F.lit(float(fixed[k][c])) for c in POSE[3:]))
        t, q = G.compose(*((t, q) if k < len(up) else G.inverse(t, q)), *pose("_"))
        out = out.select(*kept, *[c.alias(n) for n, c in zip(mine, [*t, *q], strict=True)])
    names = F.array(*[F.lit(child) for child, _ in up + back]) if up + back else F.array().cast("array<string>")
    good = F.col("_f").isNull()
    out = out.select("timestamp_ns", *[F.when(good, F.col(n)).alias(c) for n, c in zip(mine, POSE, strict=True)], F.col("_f._why").alias("reason"), F.get(names, F.col("_f._k")).alias("frame"), F.explode(F.sequence(F.lit(1), "_n")).alias("_"))
    return out.drop("_")


def looked_up(stamps: DataFrame, edges: DataFrame, ref: str, of: str) -> DataFrame:
    """timestamp_ns and the pose of `of` in `ref`, as `sampled`; stamps without a pose go."""
    return sampled(stamps, edges, ref, of).where("reason IS NULL").select("timestamp_ns", *POSE)


def skipped(samples: DataFrame) -> DataFrame:
    """reason, frame, n_skipped, first_ns and last_ns of the samples without a pose."""
    lost = samples.where("reason IS NOT NULL").groupBy("reason", "frame")
    return lost.agg(F.count("*").alias("n_skipped"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"))


def static_extrinsic(edges: DataFrame, ref: str, of: str) -> tuple[float, ...]:
    """The pose (tx .. qw) of `of` in `ref` over static edges; KeyError with the frames that no static edge names, ValueError where there is no way."""
    still = edges.where("is_static")
    named = still.select(F.explode(F.array("parent", "child")).alias("f")).where(F.col("f").isin(ref, of)).distinct()
    known = {r["f"] for r in named.collect()}  # two rows at most
    missing = [f for f in dict.fromkeys((ref, of)) if f not in known]
    if missing:
        raise KeyError(*missing)
    r = looked_up(edges.sparkSession.range(1).select(F.col("id").alias("timestamp_ns")), still, ref, of).first()
    return tuple(r[c] for c in POSE)


def edge_sets(transforms: DataFrame) -> DataFrame:
    """topic, is_static, parent and child: the distinct edges of each topic, those with an empty name left out."""
    named = (F.col("parent") != "") & (F.col("child") != "")
    return transforms.where(named).select("topic", "is_static", "parent", "child").distinct()


def union_tree(edge_sets_: DataFrame) -> DataFrame:
    """parent, child and kind of the tree of all topics: an edge that any topic publishes as static is static."""
    return edge_sets_.groupBy("parent", "child").agg(F.when(F.max(F.col("is_static").cast("int")) == 1, "static").otherwise("moving").alias("kind"))


def tree_faults(edges: DataFrame) -> DataFrame:
    """fault and frame of a whole tree: faults of its form and of its values."""
    return forest_faults(edges).unionByName(bad_values(edges).select("fault", F.col("child").alias("frame"))).distinct()


def trajectory(edges: DataFrame, topic: str, ref: str, of: str) -> DataFrame:
    """As `sampled`, at the stamps of the topic's edges that lie on the way.

    edges: topic, parent, child, stamp_ns, is_static and the pose. Raises where the
    topic has no edge, there is no way, or none of the topic's edges is on it.
    """
    own = edges.where(F.col("topic") == topic)
    if own.isEmpty():
        raise ValueError(f"{topic!r} holds no transforms")
    way = path_between(edges, ref, of)
    stamps = own.where(F.col("child").isin(way[0][:-1] + way[1][:-1])).select(F.col("stamp_ns").alias("timestamp_ns")).distinct()
    if stamps.isEmpty():
        raise ValueError(f"{topic!r} has no stamps between {ref!r} and {of!r}")
    return sampled(stamps, edges, ref, of, way)


def transform_json(ref: str, of: str) -> Column:
    """A pose (tx .. qw) as JSON: of, ref, translation, and rotation as quaternion, rpy_rad and rpy_deg."""
    from chronolane.functions import geometry as G

    t, q = pose()
    angles = dict(zip(("roll", "pitch", "yaw"), G.to_rpy(q), strict=True))
    part = lambda values: F.struct(*[v.alias(k) for k, v in values.items()])
    rotation = {"quaternion": part(dict(zip("xyzw", q, strict=True))), "rpy_rad": part(angles), "rpy_deg": part({k: F.degrees(v) for k, v in angles.items()})}
    return F.to_json(part({"of": F.lit(of), "ref": F.lit(ref), "translation": part(dict(zip("xyz", t, strict=True))), "rotation": part(rotation)}))
