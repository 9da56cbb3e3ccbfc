"""Parts from features, carcasses from panels, labels from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Millimetres within which two lengths are the same; a thickness up to which a panel is a back.
SAME_MM, BACK_MM = 3.0, 8.0
# Least area of a door, least length-to-width of a shelf, least pin holes of a side.
DOOR_MM2, LONG, PINS = 80_000.0, 3.0, 4
ACCEPT = 0.75


def parts(panels: DataFrame, annotations: DataFrame) -> DataFrame:
    """(panel_id, part_type, confidence, alternatives): the best of the candidates that a panel's features and size speak for, and up to three more."""
    n = lambda c: F.coalesce(F.sum((F.col("feature_class") == c).cast("bigint")), F.lit(0))
    counted = annotations.groupBy("panel_id").agg(n("HINGE_CUP_HOLE").alias("cups"), n("SHELF_PIN_HOLE").alias("pins"), n("CONFIRMAT_HOLE").alias("screws"), n("DOWEL_HOLE").alias("dowels"), n("HARDWARE_HOLE").alias("fittings"))
    p = panels.join(counted, "panel_id", "left").na.fill(0, ["cups", "pins", "screws", "dowels", "fittings"])
    area, aspect, joined = F.col("w") * F.col("h"), F.greatest("w", "h") / F.least("w", "h"), F.col("screws") + F.col("dowels")
    candidates = [
        ("DOOR", F.col("cups") >= 1, F.when(F.col("cups") >= 2, 0.90).otherwise(0.75)),
        ("SIDE_PANEL", F.col("pins") >= PINS, F.when(joined > 0, 0.85).otherwise(0.72)),
        ("BACK_PANEL", (F.col("thickness") <= BACK_MM) & (area >= DOOR_MM2) & (F.col("cups") + F.col("pins") + F.col("screws") == 0), F.lit(0.70)),
        ("SHELF", (aspect >= LONG) & (joined >= 1) & (F.col("pins") < PINS), F.lit(0.62)),
        ("DRAWER_FRONT", (F.col("fittings") >= 1) & (F.col("cups") == 0) & (area >= DOOR_MM2 * 0.4), F.lit(0.55)),
    ]
    each = F.array(*[F.when(cond, F.struct((-conf).alias("o"), F.lit(i).alias("i"), F.lit(name).alias("part_type"))) for i, (name, cond, conf) in enumerate(candidates)])
    ranked = F.array_sort(F.filter(each, lambda x: x.isNotNull()))
    first = F.get(ranked, F.lit(0))
    return p.select("panel_id", F.coalesce(first["part_type"], F.lit("UNKNOWN_PART")).alias("part_type"), F.coalesce(-first["o"], F.lit(0.0)).alias("confidence"), F.array_join(F.transform(F.slice(ranked, 2, 3), lambda x: x["part_type"]), ",").alias("alternatives"))


def top_two(rows: DataFrame, keys: list[str], order: Column, names: list[str]) -> DataFrame:
    """The two first rows of each key by ``order`` (a struct, unique in the key), with rank 1 and 2: aggregations only, so a key may hold any number of rows."""
    packed = rows.select(*keys, order.alias("_o"), F.struct(*names).alias("_r"))
    first = packed.groupBy(*keys).agg(F.min("_o").alias("_f"), F.min_by("_r", "_o").alias("_r"))
    rest = packed.join(first.select(*keys, "_f"), keys).where(F.col("_o") > F.col("_f"))
    second = rest.groupBy(*keys).agg(F.min_by("_r", "_o").alias("_r"))
    return first.select(*keys, F.lit(1).alias("rank"), "_r.*").unionByName(second.select(*keys, F.lit(2).alias("rank"), "_r.*"))


def carcasses(panels: DataFrame, edge_holes: DataFrame) -> DataFrame:
    """(project, panel_id, role) of each project's panels that a carcass explains.

    Sides are the congruent pair with the most holes at edges; caps share a side's short length and have such holes (the two
    largest are top and bottom, others shelves); thin panels without them are backs. Per exact size only the two panels with
    the most holes can be sides, which keeps the pair join small however many panels are alike.
    """
    total = edge_holes.select("panel_id", (F.col("left_holes") + F.col("right_holes") + F.col("bottom_holes") + F.col("top_holes")).alias("joinery"))
    p = panels.select("project", "panel_id", F.greatest("w", "h").alias("long"), F.least("w", "h").alias("short"), (F.col("w") * F.col("h")).alias("area"), "thickness").join(total, "panel_id", "left").na.fill(0, ["joinery"])
    big = p.groupBy("project").agg(F.count(F.lit(1)).alias("_n")).where("_n >= 3").select("project")
    p = p.join(big, "project", "left_semi")
    best = top_two(p, ["project", "long", "short"], F.struct((-F.col("joinery")).alias("j"), "panel_id"), ["panel_id", "joinery"])
    cell = lambda c: F.floor(F.col(c) / SAME_MM).cast("bigint")
    a = best.select("project", cell("long").alias("cl"), cell("short").alias("cs"), F.col("panel_id").alias("a"), F.col("long").alias("la"), F.col("short").alias("sa"), F.col("joinery").alias("ja"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    b = best.withColumn("_d", around).select("project", (cell("long") + F.col("_d.i")).alias("cl"), (cell("short") + F.col("_d.j")).alias("cs"), F.col("panel_id").alias("b"), F.col("long").alias("lb"), F.col("short").alias("sb"), F.col("joinery").alias("jb"))
    pairs = a.join(b, ["project", "cl", "cs"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("la") - F.col("lb")) <= SAME_MM) & (F.abs(F.col("sa") - F.col("sb")) <= SAME_MM))
    sides = pairs.groupBy("project").agg(F.min_by(F.struct("a", "b", F.col("sa").alias("depth")), F.struct((-(F.col("ja") + F.col("jb"))).alias("j"), "a", "b")).alias("_s")).select("project", "_s.*")
    rest = p.join(sides, "project").where((F.col("panel_id") != F.col("a")) & (F.col("panel_id") != F.col("b")))
    caps = rest.where((F.col("joinery") > 0) & ((F.abs(F.col("long") - F.col("depth")) <= SAME_MM) | (F.abs(F.col("short") - F.col("depth")) <= SAME_MM)))
    two = top_two(caps, ["project"], F.struct((-F.col("area")).alias("s"), "panel_id"), ["panel_id"])
    cap_roles = caps.select("project", "panel_id").join(two, ["project", "panel_id"], "left").select("project", "panel_id", F.when(F.col("rank") == 1, "TOP_PANEL").when(F.col("rank") == 2, "BOTTOM_PANEL").otherwise("SHELF").alias("role"))
    backs = rest.where((F.col("thickness") <= BACK_MM) & (F.col("joinery") == 0)).select("project", "panel_id", F.lit("BACK_PANEL").alias("role"))
    side_roles = sides.select("project", F.explode(F.array("a", "b")).alias("panel_id"), F.lit("SIDE_PANEL").alias("role"))
    return side_roles.unionByName(cap_roles).unionByName(backs)


def assemblies(roles: DataFrame) -> DataFrame:
    """(project, panels, solved, confidence) of each carcass: solved with two sides and a cap."""
    n = lambda *r: F.sum(F.col("role").isin(*r).cast("bigint"))
    by = roles.groupBy("project").agg(F.count(F.lit(1)).alias("panels"), n("SIDE_PANEL").alias("_s"), n("TOP_PANEL", "BOTTOM_PANEL", "SHELF").alias("_c"))
    solved = (F.col("_s") == 2) & (F.col("_c") > 0)
    return by.select("project", "panels", solved.alias("solved"), F.when(solved, F.least(F.lit(0.85), 0.4 + 0.1 * F.col("panels") + 0.05)).otherwise(0.0).alias("confidence"))


# Part types of a carcass and of a drawer.
CARCASS_PARTS = ["SIDE_PANEL", "TOP_PANEL", "BOTTOM_PANEL", "BACK_PANEL", "SHELF"]
DRAWER_PARTS = ["DRAWER_FRONT", "DRAWER_SIDE", "DRAWER_BACK", "DRAWER_BOTTOM"]


def grouped(panels: DataFrame, part_table: DataFrame, roles: DataFrame, tol: float = 1.0) -> DataFrame:
    """(project, panel_id, assembly_id, part_type, how) of every panel: all panels of a project that solves as a carcass together, with the roles found; else those of one thickness band, two and more; else each alone.

    An assembly is named by its project and smallest panel.
    """
    c = F.col
    solved = assemblies(roles).where("solved").select("project", F.lit(True).alias("_solved"))
    role = roles.select("panel_id", "role")
    known = panels.select("project", "panel_id", F.bround(c("thickness") / tol, 0).alias("_band")).join(part_table.select("panel_id", "part_type"), "panel_id", "left").join(solved, "project", "left").join(role, "panel_id", "left")
    bands = known.where("_solved is null and _band is not null").groupBy("project", "_band").agg(F.count(F.lit(1)).alias("_n"), F.min("panel_id").alias("_first"))
    whole = known.where("_solved").groupBy("project").agg(F.min("panel_id").alias("_least"))
    met = known.join(bands, ["project", "_band"], "left").join(whole, "project", "left")
    how = F.when(c("_solved"), "carcass").when(c("_n") >= 2, "band").otherwise("single")
    first = F.when(c("_solved"), c("_least")).when(c("_n") >= 2, c("_first")).otherwise(c("panel_id"))
    return met.select("project", "panel_id", F.concat_ws(":", "project", first).alias("assembly_id"), F.when(c("_solved"), F.coalesce("role", "part_type")).otherwise(F.coalesce("part_type", F.lit("UNKNOWN_PART"))).alias("part_type"), how.alias("how"))


def assembly_table(groups: DataFrame, roles: DataFrame) -> DataFrame:
    """(project, assembly_id, panels, assembly_type, confidence, how) of each assembly."""
    c = F.col
    by = groups.groupBy("project", "assembly_id", "how").agg(F.count(F.lit(1)).alias("panels"), F.collect_set("part_type").alias("_p"))
    sure = assemblies(roles).where("solved").select("project", F.col("confidence").alias("_c"))
    met = by.join(sure, "project", "left")
    drawer = F.arrays_overlap("_p", F.lit(DRAWER_PARTS))
    body = F.size(F.array_intersect("_p", F.lit(CARCASS_PARTS))) >= 2
    carcass = c("how") == "carcass"
    kind = F.when(carcass | (body & ~drawer), "CARCASS").when(drawer, "DRAWER").otherwise("UNKNOWN_ASSEMBLY")
    confidence = F.when(carcass, c("_c")).when(drawer, 0.6).when(body, 0.7).when(c("panels") >= 2, 0.4).otherwise(0.2)
    return met.select("project", "assembly_id", "panels", kind.alias("assembly_type"), confidence.alias("confidence"), "how")


def joints(groups: DataFrame) -> DataFrame:
    """(project, assembly_id, panel_a, panel_b, confidence): sides of a carcass with its caps, the two sides of each being few."""
    named = groups.where("how = 'carcass'")
    sides = named.where("part_type = 'SIDE_PANEL'").select("project", "assembly_id", F.col("panel_id").alias("panel_a"))
    caps = named.where(F.col("part_type").isin("TOP_PANEL", "BOTTOM_PANEL", "SHELF")).select("project", "assembly_id", F.col("panel_id").alias("panel_b"))
    return sides.join(caps, ["project", "assembly_id"]).withColumn("confidence", F.lit(0.5))


def projects(table: DataFrame) -> DataFrame:
    """(project, assemblies, panels, ungrouped): a row a project."""
    one = F.col("panels") < 2
    return table.groupBy("project").agg(F.sum((~one).cast("bigint")).alias("assemblies"), F.sum("panels").alias("panels"), F.sum(one.cast("bigint")).alias("ungrouped"))


def project_labels(table: DataFrame) -> DataFrame:
    """(label_id, kind, value, confidence, status): assemblies of two panels and more, and each project, as labels."""
    status = F.when(F.col("confidence") >= ACCEPT, "auto_accepted").otherwise("needs_review").alias("status")
    a = table.where("panels >= 2").select(F.concat_ws(":", "project", F.lit("asm"), "assembly_id").alias("label_id"), F.lit("assembly").alias("kind"), F.col("assembly_type").alias("value"), "confidence", status)
    p = projects(table).withColumn("confidence", F.when(F.col("assemblies") > 0, 0.6).otherwise(0.3))
    value = F.concat(F.col("assemblies").cast("string"), F.lit("_assemblies_"), F.col("panels").cast("string"), F.lit("_panels"))
    return a.unionByName(p.select(F.concat_ws(":", "project", F.lit("project")).alias("label_id"), F.lit("project").alias("kind"), value.alias("value"), "confidence", status))


def labels(part_table: DataFrame, annotations: DataFrame) -> DataFrame:
    """(label_id, kind, value, confidence, status): features and parts as labels, those under the threshold for review."""
    status = F.when(F.col("confidence") >= ACCEPT, "auto_accepted").otherwise("needs_review").alias("status")
    f = annotations.select(F.concat_ws(":", F.lit("f"), "panel_id", "seq").alias("label_id"), F.lit("feature").alias("kind"), F.col("feature_class").alias("value"), "confidence", status)
    p = part_table.select(F.concat_ws(":", F.lit("p"), "panel_id").alias("label_id"), F.lit("part").alias("kind"), F.col("part_type").alias("value"), "confidence", status)
    return f.unionByName(p)


def complexity(annotations: DataFrame) -> DataFrame:
    """Whether a panel is simple, medium or complex by its features' number and kinds."""
    milled = F.col("feature_class").isin("GROOVE", "POCKET", "THROUGH_POCKET", "RABBET", "OPEN_SLOT", "DADO", "ENGRAVING", "INTERNAL_CUTOUT")
    by = annotations.groupBy("panel_id").agg(F.countDistinct("feature_class").alias("k"), F.count(F.lit(1)).alias("n"), F.max(milled).alias("m"), F.max(~milled).alias("d"))
    hard, easy = (F.col("k") > 5) | (F.col("n") > 15) | (F.col("m") & F.col("d")), (F.col("k") <= 3) & (F.col("n") <= 5) & ~F.col("m")
    return by.select("panel_id", F.col("k").alias("kinds"), F.col("n").alias("features"), F.when(hard, "complex").when(easy, "simple").otherwise("medium").alias("complexity"))
