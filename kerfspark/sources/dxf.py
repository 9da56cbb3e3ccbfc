"""Drawing exchange files (ASCII group codes) to tables of entities, and back.

``read_dxf`` lists files with Spark's binary source and parses each in a Python worker; ``parse`` takes any table with
``path`` and ``content``. Files that can't be read give a row of warnings, never an error. Measures of the parsed shapes
(area, length, box) are column expressions over their vertices. ``render`` writes a drawing's text as a column expression.

Guards and meanings: files over ``max_bytes`` aren't parsed; inches in the header are converted to millimetres; only model
space counts; bulges, splines and ellipses become chords and are marked as approximated; block references are exploded to a
depth of five, with layer 0 taking the reference's layer; a zero elevation is none.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kerfspark.functions import geometry as g
from kerfspark.functions.layers import depth_from_layer, layer_type

PARSED = "source_file string, source_file_hash string, version string, units int, seq int, kind string, handle string, entity_type string, layer string, vertices array<array<double>>, numbers array<double>, is_closed boolean, is_approximated boolean, elevation_z double, top_z double, warning string"
MAX_BYTES, SEGMENTS, CHORD_MM, DEPTH = 50 << 20, 50, 0.05, 5
#: Bytes of files whose rows a task holds before it hands them on.
HELD_BYTES = 4 << 20


def pairs(text: str) -> list[tuple[int, str]]:
    lines = text.splitlines()
    out = []
    for i in range(0, len(lines) - 1, 2):
        try:
            out.append((int(lines[i]), lines[i + 1].strip()))
        except ValueError as e:
            raise ValueError(f"no group code in line {i + 1}") from e
    return out


def records(codes: list[tuple[int, str]]) -> Iterator[tuple[str, list[tuple[int, str]]]]:
    """(type, group codes) of each record that code 0 opens."""
    kind, held = None, []
    for c, v in codes:
        if c == 0:
            if kind is not None:
                yield kind, held
            kind, held = v, []
        elif kind is not None:
            held.append((c, v))
    if kind is not None:
        yield kind, held


def one(codes, code: int, default=None, of=float):
    return next((of(v) for c, v in codes if c == code), default)


def arc_points(cx: float, cy: float, r: float, a0: float, a1: float, segments: int) -> list[list[float]]:
    steps = max(2, min(segments * 4, math.ceil(abs(a1 - a0) / (2 * math.acos(max(0.0, 1 - CHORD_MM / r)) if r > CHORD_MM else math.pi / 2))))
    return [[cx + r * math.cos(a0 + (a1 - a0) * i / steps), cy + r * math.sin(a0 + (a1 - a0) * i / steps)] for i in range(steps + 1)]


def bulged(points: list[tuple[float, float, float]], closed: bool, segments: int) -> tuple[list[list[float]], bool]:
    """Vertices of a polyline whose edges may be arcs, and whether any was."""
    out, bent = [], False
    n = len(points)
    for i, (x, y, b) in enumerate(points):
        out.append([x, y])
        if abs(b) > 1e-9 and (closed or i < n - 1):
            bent = True
            x2, y2, _ = points[(i + 1) % n]
            chord = math.hypot(x2 - x, y2 - y)
            if chord == 0:
                continue
            angle = 4 * math.atan(b)
            r = chord / (2 * math.sin(abs(angle) / 2))
            mx, my = (x + x2) / 2, (y + y2) / 2
            h = r * math.cos(angle / 2) * (1 if b > 0 else -1)
            cx, cy = mx - h * (y2 - y) / chord, my + h * (x2 - x) / chord
            a0 = math.atan2(y - cy, x - cx)
            out += arc_points(cx, cy, r, a0, a0 + angle, segments)[1:-1]
    return out, bent


def spline_points(degree: int, knots: list[float], control: list[list[float]], segments: int) -> list[list[float]]:
    """Points of a B-spline by De Boor's recursion."""
    lo, hi = knots[degree], knots[len(control)]
    out = []
    for s in range(segments + 1):
        t = lo + (hi - lo) * s / segments
        k = max(i for i in range(degree, len(control)) if knots[i] <= t) if t < hi else max(i for i in range(degree, len(control)) if knots[i] < hi)
        d = [list(control[j + k - degree]) for j in range(degree + 1)]
        for r in range(1, degree + 1):
            for j in range(degree, r - 1, -1):
                w = knots[j + 1 + k - r] - knots[j + k - degree]
                a = (t - knots[j + k - degree]) / w if w else 0.0
                d[j] = [(1 - a) * p + a * q for p, q in zip(d[j - 1], d[j])]
        out.append(d[degree][:2])
    return out


def placed(p: list[float], at: tuple) -> list[float]:
    x, y, sx, sy, angle, bx, by = at
    u, v = (p[0] - bx) * sx, (p[1] - by) * sy
    return [x + u * math.cos(angle) - v * math.sin(angle), y + u * math.sin(angle) + v * math.cos(angle)]


def shapes(kind: str, codes: list, following: list, blocks: dict, segments: int, depth: int = 0, under: str = "") -> Iterator[dict]:
    """Rows of one record; block references give those of their block."""
    handle, layer = one(codes, 5, "", str) + under, one(codes, 8, "0", str)
    z = one(codes, 38, None) if kind == "LWPOLYLINE" else one(codes, 30, None)
    base = {"handle": handle, "entity_type": kind, "layer": layer, "elevation_z": z or None, "is_closed": False, "is_approximated": False, "vertices": None, "numbers": None}
    xs, ys = [float(v) for c, v in codes if c == 10], [float(v) for c, v in codes if c == 20]
    if kind == "CIRCLE":
        r = one(codes, 40, 0.0)
        if r <= 0:
            yield {"warning": "degenerate_circle_skipped", "handle": handle}
        else:
            yield base | {"numbers": [xs[0], ys[0], r], "is_closed": True}
    elif kind == "ARC":
        yield base | {"numbers": [xs[0], ys[0], one(codes, 40), one(codes, 50, 0.0), one(codes, 51, 360.0)]}
    elif kind == "LINE":
        yield base | {"vertices": [[xs[0], ys[0]], [one(codes, 11), one(codes, 21)]]}
    elif kind in ("LWPOLYLINE", "POLYLINE"):
        closed = bool(one(codes, 70, 0, int) & 1)
        if kind == "LWPOLYLINE":
            points: list = []
            for c, v in codes:
                if c == 10:
                    points.append([float(v), 0.0, 0.0])
                elif c in (20, 42) and points:
                    points[-1][1 if c == 20 else 2] = float(v)
        else:
            points = [[one(v, 10, 0.0), one(v, 20, 0.0), one(v, 42, 0.0)] for v in following]
        if len(points) < 2:
            yield {"warning": "degenerate_polyline_skipped", "handle": handle}
        else:
            flat, bent = bulged(points, closed, segments)
            yield base | {"vertices": flat, "is_closed": closed, "is_approximated": bent}
    elif kind == "SPLINE":
        degree, knots = one(codes, 71, 3, int), [float(v) for c, v in codes if c == 40]
        control = [list(p) for p in zip(xs, ys)]
        if len(control) <= degree or len(knots) < len(control) + degree + 1:
            yield {"warning": "degenerate_spline_skipped", "handle": handle}
        else:
            flat = spline_points(degree, knots, control, max(4, segments))
            yield base | {"vertices": flat, "is_closed": bool(one(codes, 70, 0, int) & 1), "is_approximated": True}
    elif kind == "ELLIPSE":
        ax, ay, ratio = one(codes, 11), one(codes, 21), one(codes, 40, 1.0)
        t0, t1 = one(codes, 41, 0.0), one(codes, 42, 2 * math.pi)
        whole = abs(t1 - t0 - 2 * math.pi) < 1e-9
        n = max(8, segments)
        at = [t0 + (t1 - t0) * i / n for i in range(n if whole else n + 1)]
        yield base | {"vertices": [[xs[0] + ax * math.cos(t) - ay * ratio * math.sin(t), ys[0] + ay * math.cos(t) + ax * ratio * math.sin(t)] for t in at], "is_closed": whole, "is_approximated": True}
    elif kind == "INSERT":
        name = one(codes, 2, "", str)
        if depth >= DEPTH or name not in blocks:
            yield {"warning": "insert_not_exploded", "handle": handle}
            return
        bx, by, inner = blocks[name]
        sx, sy, angle = one(codes, 41, 1.0), one(codes, 42, 1.0), math.radians(one(codes, 50, 0.0))
        at = (xs[0], ys[0], sx, sy, angle, bx, by)
        for n, (k, c, f) in enumerate(inner):
            for row in shapes(k, c, f, blocks, segments, depth + 1, f"-i{one(codes, 5, '', str)}-{n}"):
                if "warning" not in row:
                    if row["layer"] == "0":
                        row["layer"] = layer
                    if row["vertices"]:
                        row["vertices"] = [placed(p, at) for p in row["vertices"]]
                    elif abs(sx) == abs(sy):
                        m = row["numbers"]
                        turned = [(a + math.degrees(angle)) % 360 for a in m[3:]]
                        row["numbers"] = [*placed(m[:2], at), m[2] * abs(sx), *turned]
                    else:
                        m = row["numbers"]
                        a0, a1 = (math.radians(m[3]), math.radians(m[4])) if len(m) > 3 else (0.0, 2 * math.pi)
                        a1 += 2 * math.pi if a1 <= a0 else 0
                        row |= {"vertices": [placed(p, at) for p in arc_points(m[0], m[1], m[2], a0, a1, segments)], "numbers": None, "is_approximated": True}
                yield row
    elif kind not in ("SEQEND", "VERTEX", "ENDBLK", "ENDSEC", "ATTRIB", "EOF", "VIEWPORT"):
        yield {"warning": f"unsupported_{kind.lower()}", "handle": handle}


def grouped(section: list[tuple[str, list]]) -> list[tuple[str, list, list]]:
    """Records with the VERTEX records that belong to them."""
    out: list = []
    for kind, codes in section:
        if kind == "VERTEX" and out:
            out[-1][2].append(codes)
        else:
            out.append((kind, codes, []))
    return out


def drawing(content: bytes, segments: int = SEGMENTS) -> tuple[str | None, int, list[dict]]:
    """Version, header unit and rows of one file."""
    if b"SECTION" not in content[:100_000] and b"SECTION" not in content:
        return None, 0, [{"warning": "no_drawing"}]
    codes = pairs(content.decode("utf-8", "replace"))
    sections: dict[str, list] = {}
    name, held, version, units = None, [], None, 0
    for i, (c, v) in enumerate(codes):
        if c == 9 and v == "$ACADVER":
            version = codes[i + 1][1]
        elif c == 9 and v == "$INSUNITS":
            units = int(codes[i + 1][1])
        if c == 0 and v == "SECTION":
            name, held = codes[i + 1][1] if i + 1 < len(codes) else "", []
        elif c == 0 and v == "ENDSEC":
            sections[name] = held
            name = None
        elif name is not None:
            held.append((c, v))
    if name is not None:
        sections[name] = held
    blocks: dict = {}
    open_block = None
    for kind, c, f in grouped(list(records(sections.get("BLOCKS", [])))):
        if kind == "BLOCK":
            open_block = blocks.setdefault(one(c, 2, "", str), (one(c, 10, 0.0), one(c, 20, 0.0), []))
        elif kind == "ENDBLK":
            open_block = None
        elif open_block is not None:
            open_block[2].append((kind, c, f))
    rows: list[dict] = []
    for kind, c, f in grouped(list(records(sections.get("ENTITIES", [])))):
        if one(c, 67, 0, int) == 1:
            continue
        try:
            rows += list(shapes(kind, c, f, blocks, segments))
        except (ValueError, TypeError, IndexError, ZeroDivisionError) as e:
            rows.append({"warning": f"entity_read_error: {type(e).__name__}", "handle": one(c, 5, "", str)})
    if units == 1:
        for r in rows:
            if r.get("vertices"):
                r["vertices"] = [[x * 25.4 for x in p] for p in r["vertices"]]
            if r.get("numbers"):
                r["numbers"] = [x * 25.4 for x in r["numbers"][:3]] + r["numbers"][3:]
            if r.get("elevation_z"):
                r["elevation_z"] *= 25.4
    if not any("warning" not in r for r in rows):
        rows.append({"warning": "empty_file"})
    return version, units, rows


def parse(files: DataFrame, max_bytes: int = MAX_BYTES, segments: int = SEGMENTS) -> DataFrame:
    """Entities and warnings of (path, content) rows, in the order of the file."""
    names = [x.split()[0] for x in PARSED.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, held = [], 0
        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                content = bytes(content or b"")
                try:
                    version, units, found = (None, 0, [{"warning": "too_large"}]) if len(content) > max_bytes else drawing(content, segments)
                except (ValueError, IndexError, RecursionError) as e:
                    version, units, found = None, 0, [{"warning": f"corrupt: {e}"}]
                top = max((r["elevation_z"] for r in found if r.get("elevation_z") is not None), default=None)
                head = {"source_file": path, "source_file_hash": "sha256:" + hashlib.sha256(content).hexdigest(), "version": version, "units": units, "top_z": top}
                for i, r in enumerate(found):
                    row = head | {"seq": i, "kind": "warning" if "warning" in r else "entity"} | r
                    rows.append([row.get(n) for n in names])
                held += len(content)
                if held > HELD_BYTES:
                    yield pd.DataFrame(rows, columns=names, dtype=object)
                    rows, held = [], 0
        yield pd.DataFrame(rows, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, PARSED)


def read_dxf(spark: SparkSession, path: str, **options) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[dD][xX][fF]").load(path)
    return parse(files, **options)


def entities(parsed: DataFrame) -> DataFrame:
    """The parsed shapes with their measures, layer type and depth."""
    v, n, closed = F.col("vertices"), F.col("numbers"), F.col("is_closed")
    circle = F.col("entity_type").isin("CIRCLE", "ARC") & n.isNotNull()
    pi = 3.141592653589793
    r = n[2]
    area = F.when(circle & closed, pi * r * r).when(closed & (F.size(v) >= 3), F.abs(g.signed_area(v)))
    length = F.when(circle & closed, 2 * pi * r).when(circle, F.radians(F.pmod(F.get(n, F.lit(4)) - F.get(n, F.lit(3)), F.lit(360.0))) * r).otherwise(g.ring_length(v, closed & (F.size(v) >= 3)))
    box = F.when(circle, F.struct((n[0] - r).alias("xmin"), (n[1] - r).alias("ymin"), (n[0] + r).alias("xmax"), (n[1] + r).alias("ymax"))).otherwise(g.box(v))
    kind = layer_type(F.col("layer"))
    out = parsed.where("kind = 'entity'").withColumns({"area_mm2": F.round(area, 4), "perimeter_mm": F.round(length, 4), "box": box, "diameter_mm": F.when(circle, 2 * r), "layer_type": kind})
    reference = F.greatest(F.lit(0.0), F.coalesce(F.col("top_z"), F.lit(0.0)))
    below = F.when(F.col("elevation_z").isNotNull() & (reference - F.col("elevation_z") > 1e-6), F.round(reference - F.col("elevation_z"), 6))
    named = depth_from_layer(F.col("layer"), F.col("layer_type"))
    return out.withColumns({"depth_mm": F.coalesce(below, named), "depth_source": F.when(below.isNotNull(), "z_elevation").when(named.isNotNull(), "layer_name")}).drop("top_z", "kind", "warning")


def corpus(parsed: DataFrame) -> DataFrame:
    """One row of counters: files, those with and without shapes, shapes, warnings, and files that couldn't be read."""
    c = F.col
    by = parsed.groupBy("source_file").agg(F.sum((c("kind") == "entity").cast("bigint")).alias("e"), F.sum((c("kind") == "warning").cast("bigint")).alias("w"), F.max(F.coalesce(c("warning").rlike("^(corrupt|too_large|no_drawing)"), F.lit(False))).alias("bad"))
    n = lambda cond: F.coalesce(F.sum(cond.cast("bigint")), F.lit(0))
    return by.agg(F.count(F.lit(1)).alias("files"), n(c("e") > 0).alias("with_shapes"), n(c("e") == 0).alias("without_shapes"), n(c("bad")).alias("unreadable"), F.coalesce(F.sum("e"), F.lit(0)).alias("shapes"), F.coalesce(F.sum("w"), F.lit(0)).alias("warnings"))


def boundaries(shapes_: DataFrame) -> DataFrame:
    """Of each file, the largest closed contour, or the box of all shapes by 10 mm larger."""
    ring = F.col("is_closed") & (F.size("vertices") >= 3)
    best = F.max_by(F.struct("seq", "box"), F.when(ring, F.struct("area_mm2", (-F.col("seq")).alias("o"))))
    edge = lambda f, c: f(F.col(f"box.{c}"))
    by = shapes_.groupBy("source_file").agg(F.max(F.when(ring, F.lit(True))).alias("_has"), best.alias("_best"), *[edge(F.min if c.endswith("min") else F.max, c).alias(c) for c in ("xmin", "ymin", "xmax", "ymax")])
    inferred = F.col("_has").isNull()
    pick = lambda c, d: F.when(inferred, F.col(c) + d).otherwise(F.col(f"_best.box.{c}")).alias(c)
    return by.select("source_file", inferred.alias("inferred"), F.when(~inferred, F.col("_best.seq")).alias("seq"), pick("xmin", -10.0), pick("ymin", -10.0), pick("xmax", 10.0), pick("ymax", 10.0))


def render(panel: dict[str, Column], circles: Column) -> Column:
    """A drawing's text: the panel's outline on BORDER, and circles (array of structs x, y, r, layer)."""
    line = lambda *xs: F.concat_ws("\n", *[x if isinstance(x, Column) else F.lit(str(x)) for x in xs])
    s = lambda c: c.cast("string")
    corner = lambda x, y: line(10, s(panel[x]), 20, s(panel[y]))
    outline = line(0, "LWPOLYLINE", 5, "B0", 8, "BORDER", 90, 4, 70, 1, corner("xmin", "ymin"), corner("xmax", "ymin"), corner("xmax", "ymax"), corner("xmin", "ymax"))
    holes = F.transform(circles, lambda c, i: line(0, "CIRCLE", 5, F.concat(F.lit("C"), s(i)), 8, c["layer"], 10, s(c["x"]), 20, s(c["y"]), 40, s(c["r"])))
    head = line(0, "SECTION", 2, "HEADER", 9, "$ACADVER", 1, "AC1024", 9, "$INSUNITS", 70, 4, 0, "ENDSEC", 0, "SECTION", 2, "ENTITIES")
    return F.concat_ws("\n", head, outline, F.concat_ws("\n", holes), line(0, "ENDSEC", 0, "EOF"), F.lit(""))
