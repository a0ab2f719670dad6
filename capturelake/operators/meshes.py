"""Mesh analytics over ``vertices`` (v_idx, x, y, z) and ``faces`` (f_idx, a, b, c)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import cross, dot, minus, norm
from ..functions.scores import clamp
from .scale import HOT_ROWS, attach, group_sizes

AXES = ("x", "y", "z")
KEY = ["cloud_id"]

# Face groups in the order that wins ties, with their directions.
FACE_GROUPS = {
    "front": (0.0, 0.0, 1.0),
    "back": (0.0, 0.0, -1.0),
    "left": (-1.0, 0.0, 0.0),
    "right": (1.0, 0.0, 0.0),
    "top": (0.0, 1.0, 0.0),
    "bottom": (0.0, -1.0, 0.0),
}
LIGHT = (0.25, 0.45, 0.86)
#: Corners or edges that a task joins and groups; larger meshes take more tasks.
TASK_ROWS = 500_000
NEUTRAL = (180, 180, 180)


def corner_tasks(faces: DataFrame, rows: int) -> int:
    """Tasks for three rows of each of so many faces: the session's number, or more."""
    return max(int(faces.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * rows // TASK_ROWS))


def _face_rows(faces: DataFrame) -> tuple[int, int]:
    """All faces, and those of the largest mesh."""
    return tuple(n or 0 for n in group_sizes(faces, KEY).agg(F.sum("_rows"), F.max("_rows")).first())


def with_corners(faces: DataFrame, vertices: DataFrame, hot_rows: int = HOT_ROWS, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Faces with the coordinates of their corners.

    Corners are looked up in long form, one row per (face, corner), with a
    single join and one aggregate per face, in as many tasks as the faces
    need. Meshes that fit a task meet their vertices there: one shuffle by mesh
    does for the join, the aggregate and what is grouped by mesh afterwards,
    and none where both tables lie so already. No vertex has more uses than its
    cloud has faces; where a cloud is hot, a vertex shared by many faces (the
    hub of a fan) is spread by a salt.
    """
    c = F.col
    rows, largest = sizes or _face_rows(faces)
    tasks = corner_tasks(faces, rows)
    long = faces.select(*KEY, "f_idx", F.posexplode(F.array("a", "b", "c")).alias("_k", "v_idx"))
    coords = vertices.select(*KEY, "v_idx", *AXES)
    if 3 * largest <= min(TASK_ROWS, hot_rows):
        met = long.unionByName(coords.withColumn("_known", F.lit(True)), allowMissingColumns=True).filter("cloud_id IS NOT NULL AND v_idx IS NOT NULL").repartition(tasks, *KEY)
        at = Window.partitionBy(*KEY, "v_idx")
        return _faces_of(met.select(*KEY, "f_idx", "_k", "v_idx", *[F.max(n).over(at).alias(n) for n in (*AXES, "_known")]).filter("_k IS NOT NULL AND _known"))
    if largest > hot_rows:
        use = long.groupBy(*KEY, "v_idx").agg(F.count(F.lit(1)).alias("_uses"))
        placed = attach(long, use.join(coords, [*KEY, "v_idx"]), [*KEY, "v_idx"], c("_uses"), hot_rows)
    else:
        placed = long.repartition(tasks, *KEY, "v_idx").join(coords.repartition(tasks, *KEY, "v_idx"), [*KEY, "v_idx"])
    return _faces_of(placed.repartition(tasks, *KEY, "f_idx"))


def _faces_of(corners: DataFrame) -> DataFrame:
    """One row per face from its corners in long form."""
    def at(k: int, value: str) -> Column:
        return F.max(F.when(F.col("_k") == k, F.col(value)))

    return corners.groupBy(*KEY, "f_idx").agg(
        *[at(k, "v_idx").alias(n) for k, n in enumerate("abc")], *[at(k, a).alias(f"{a}{k}") for k in range(3) for a in AXES])


def _corner(k: int) -> tuple[Column, Column, Column]:
    return F.col(f"x{k}"), F.col(f"y{k}"), F.col(f"z{k}")


def _raw_normal() -> tuple[Column, Column, Column]:
    return cross(minus(_corner(1), _corner(0)), minus(_corner(2), _corner(0)))


def mesh_counts(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    v = vertices.groupBy(*KEY).agg(F.count(F.lit(1)).alias("vertex_count"))
    f = faces.groupBy(*KEY).agg(F.count(F.lit(1)).alias("face_count"))
    return v.join(f, KEY, "left").select(*KEY, "vertex_count", F.coalesce("face_count", F.lit(0)).alias("face_count"))


def watertight(faces: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Whether every undirected edge belongs to exactly two faces."""
    tasks = corner_tasks(faces, (sizes or _face_rows(faces))[0])
    ends = F.array(*[
        F.struct(F.least(p, q).alias("u"), F.greatest(p, q).alias("v")) for p, q in (("a", "b"), ("b", "c"), ("c", "a"))])
    edges = faces.select(*KEY, F.explode(ends).alias("_e")).select(*KEY, "_e.u", "_e.v").repartition(tasks, *KEY, "u", "v").groupBy(
        *KEY, "u", "v").agg(F.count(F.lit(1)).alias("_n"))
    return edges.groupBy(*KEY).agg(F.bool_and(F.col("_n") == 2).alias("is_watertight"))


def mesh_diagnostics(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """Extents, volumes, area, fill ratio and watertightness per mesh."""
    c = F.col
    box = vertices.groupBy(*KEY).agg(*[(F.max(a) - F.min(a)).alias(f"e{a}") for a in AXES])
    n, sizes = _raw_normal(), _face_rows(faces)
    solid = with_corners(faces, vertices, sizes=sizes).groupBy(*KEY).agg(
        F.abs(F.sum(dot(_corner(0), cross(_corner(1), _corner(2))) / 6.0)).alias("_volume"),
        (F.sum(norm(n)) / 2.0).alias("_area"),
    )
    df = box.join(solid, KEY, "left").join(watertight(faces, sizes), KEY, "left")
    extents = F.array("ex", "ey", "ez")
    positive = F.filter(extents, lambda e: e > 1e-9)
    bbox = F.when(F.size(positive) == 3, F.round(c("ex") * c("ey") * c("ez"), 6))
    return df.select(
        *KEY, *[F.round(f"e{a}", 6).alias(f"extent_{a}") for a in AXES],
        F.round(F.array_max(positive) / F.array_min(positive), 6).alias("extent_ratio_max_min"),
        bbox.alias("bbox_volume"), F.round("_volume", 6).alias("mesh_volume"),
        F.when(bbox > 1e-9, F.round(c("_volume") / bbox, 6)).alias("mesh_volume_to_bbox_volume_ratio"),
        F.round("_area", 6).alias("mesh_surface_area"), "is_watertight",
    )


def face_groups(faces: DataFrame, vertices: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Side of a box each face looks at: the direction closest to its normal."""
    n = _raw_normal()
    length = norm(n)
    unit = [x / F.when(length <= 1e-12, 1.0).otherwise(length) for x in n]
    lit = [tuple(F.lit(v) for v in d) for d in FACE_GROUPS.values()]
    scores = F.array(*[dot(tuple(unit), d) for d in lit])
    names = F.array(*[F.lit(g) for g in FACE_GROUPS])
    place = F.array_position(scores, F.array_max(scores)).cast("int")
    return with_corners(faces, vertices, sizes=sizes).select(*KEY, "f_idx", "a", "b", "c", F.element_at(names, place).alias("face_group"))


def face_group_counts(groups: DataFrame) -> DataFrame:
    return groups.groupBy(*KEY, "face_group").agg(F.count(F.lit(1)).alias("faces"))


def paint_face_groups(groups: DataFrame, palette: DataFrame) -> DataFrame:
    """Vertex colour by side; a vertex on several sides takes the last painted one.

    ``palette`` has up to six (slot, r, g, b) rows per cloud, by image rank.
    """
    order = F.array(*[F.lit(g) for g in FACE_GROUPS])
    slot = F.array_position(order, F.col("face_group")) - 1
    corners = groups.select(*KEY, slot.alias("slot"), F.explode(F.array("a", "b", "c")).alias("v_idx"))
    last = corners.groupBy(*KEY, "v_idx").agg(F.max("slot").alias("slot"))
    # The few colours of a cloud are one row, so that vertices stay where their faces are.
    shades = palette.groupBy(*KEY).agg(F.map_from_entries(F.collect_list(F.struct("slot", F.struct(*"rgb")))).alias("_shades"))
    shade = F.col("_shades")[F.col("slot")]
    return last.join(shades, KEY, "left").select(
        *KEY, "v_idx", *[F.coalesce(shade[ch], F.lit(v)).alias(ch) for ch, v in zip("rgb", NEUTRAL)])


def shade_vertices(vertices: DataFrame, faces: DataFrame, rgb: tuple[int, int, int] = NEUTRAL,
                   strength: float = 0.2) -> DataFrame:
    """Base colour brightened or darkened by how a vertex faces the light."""
    n = _raw_normal()
    length = norm(n)
    safe = F.when(length <= 1e-12, 1.0).otherwise(length)
    unit = with_corners(faces, vertices).select(
        *KEY, F.explode(F.array("a", "b", "c")).alias("v_idx"), *[(x / safe).alias(f"n{a}") for a, x in zip(AXES, n)])
    normals = unit.groupBy(*KEY, "v_idx").agg(*[F.sum(f"n{a}").alias(f"n{a}") for a in AXES])
    vec = tuple(F.col(f"n{a}") for a in AXES)
    size = norm(vec)
    scale = sum(v * v for v in LIGHT) ** 0.5
    light = tuple(F.lit(v / scale) for v in LIGHT)
    facing = F.when(size <= 1e-12, 0.0).otherwise(dot(vec, light) / size)
    s = max(0.0, min(0.5, strength))
    factor = clamp(1.0 + s * F.coalesce(facing, F.lit(0.0)), 0.72, 1.25)
    return vertices.select(*KEY, "v_idx").join(normals, [*KEY, "v_idx"], "left").select(
        *KEY, "v_idx", *[F.floor(clamp(factor * float(v), 0.0, 255.0)).cast("int").alias(ch)
                         for ch, v in zip("rgb", rgb)])
