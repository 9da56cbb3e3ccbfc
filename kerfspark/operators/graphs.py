"""Node and edge tables of drawings: integrity, containment, features of nodes, export."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kerfspark.runtime import lookup


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node: src, dst and which ends are missing."""
    known = nodes.select(F.col("node_id").alias("_k")).distinct()
    a = edges.join(known.withColumn("_s", F.lit(True)).withColumnRenamed("_k", "src"), "src", "left")
    b = a.join(known.withColumn("_d", F.lit(True)).withColumnRenamed("_k", "dst"), "dst", "left")
    return b.where("_s is null or _d is null").select("src", "dst", F.col("_s").isNull().alias("src_missing"), F.col("_d").isNull().alias("dst_missing"))


def self_loops(edges: DataFrame) -> DataFrame:
    return edges.where("src = dst").select("src", "dst")


def orphans(geometry: DataFrame, features: DataFrame) -> DataFrame:
    """Geometry nodes that no feature refers to."""
    used = features.select(F.explode("geometry_node_ids").alias("node_id"))
    return geometry.select("node_id", "graph_id").distinct().join(used, "node_id", "left_anti")


def out_of_range(features: DataFrame) -> DataFrame:
    """Feature nodes with a confidence outside [0, 1] or a diameter that isn't positive."""
    bad_c = ~F.col("confidence").between(0.0, 1.0)
    bad_d = F.col("diameter_mm") <= 0
    return features.where(bad_c | bad_d).select("node_id", F.coalesce(bad_c, F.lit(False)).alias("bad_confidence"), F.coalesce(bad_d, F.lit(False)).alias("bad_diameter")).distinct()


def neighbours(edges: DataFrame) -> DataFrame:
    """(node_id, neighbour, direction): successors and predecessors of each node, a row each, which a node with very many spreads over."""
    return edges.select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("neighbour"), F.lit("out").alias("direction")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("neighbour"), F.lit("in").alias("direction")))).alias("e")).select("e.*")


def degrees(edges: DataFrame) -> DataFrame:
    way = lambda d: F.sum((F.col("direction") == d).cast("bigint"))
    return neighbours(edges).groupBy("node_id").agg(way("out").alias("out_degree"), way("in").alias("in_degree"))


class Graphs:
    """All graphs at once: ``nodes`` (graph_id, node_id, node_type, ...) and ``edges`` (graph_id, src, dst, edge_type); every method is a plan over them."""

    def __init__(self, nodes: DataFrame, edges: DataFrame):
        self.nodes, self.edges = nodes, edges

    def of_type(self, node_type: str) -> DataFrame:
        return self.nodes.where(F.col("node_type") == node_type)

    def geometry(self, geometry_type: str | None = None) -> DataFrame:
        g = self.of_type("geometry")
        return g if geometry_type is None else g.where(F.lower("geometry_type") == geometry_type.lower())

    def boundary(self) -> DataFrame:
        return self.geometry().where("is_outer_boundary")

    def interior(self, closed: bool = False) -> DataFrame:
        inner = self.geometry().where(~F.coalesce("is_outer_boundary", F.lit(False)))
        return inner.where("is_closed") if closed else inner

    def features(self, feature_class: str | None = None, least_confidence: float | None = None) -> DataFrame:
        f = self.of_type("feature")
        if feature_class is not None:
            f = f.where(F.upper(F.trim("feature_class")) == feature_class.upper())
        return f if least_confidence is None else f.where(F.coalesce("confidence", F.lit(0.0)) >= least_confidence)

    def groups(self) -> DataFrame:
        """(graph_id, group_id, node_id) of grouped features."""
        return self.of_type("feature").where("group_id is not null").select("graph_id", "group_id", "node_id")

    def of_edge(self, edge_type: str) -> DataFrame:
        return self.edges.where(F.col("edge_type") == edge_type)

    def edges_from(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select(F.col("node_id").alias("src")).distinct(), "src", "left_semi")

    def edges_to(self, ids: DataFrame) -> DataFrame:
        return self.edges.join(ids.select(F.col("node_id").alias("dst")).distinct(), "dst", "left_semi")

    def with_ids(self, ids: DataFrame) -> DataFrame:
        return self.nodes.join(ids.select("node_id").distinct(), "node_id", "left_semi")

    def conflicts(self) -> DataFrame:
        return self.of_edge("CONFLICTS_WITH").select("src", "dst")

    def linked(self, edge_type: str, node_type: str, other: str) -> DataFrame:
        """(node_id, linked_id) of nodes of one type with those of another that an edge of a type ties to them, in either direction."""
        both = self.of_edge(edge_type).select(F.explode(F.array(F.struct(F.col("src").alias("node_id"), F.col("dst").alias("linked_id")), F.struct(F.col("dst").alias("node_id"), F.col("src").alias("linked_id")))).alias("e")).select("e.*")
        own = self.of_type(node_type).select("node_id").distinct()
        to = self.of_type(other).select(F.col("node_id").alias("linked_id")).distinct()
        return both.join(own, "node_id", "left_semi").join(to, "linked_id", "left_semi").select("node_id", "linked_id").distinct()

    def features_for_geometry(self) -> DataFrame:
        return self.linked("COMPOSES", "geometry", "feature")

    def geometry_for_features(self) -> DataFrame:
        return self.linked("COMPOSES", "feature", "geometry")

    def violations(self, node_type: str = "feature") -> DataFrame:
        return self.linked("APPLIES_TO", node_type, "constraint")

    def summary(self) -> DataFrame:
        """(node_type, nodes, graphs)."""
        return self.nodes.groupBy("node_type").agg(F.count(F.lit(1)).alias("nodes"), F.countDistinct("graph_id").alias("graphs"))


def integrity(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(problem, node_id, other) of graphs: edges without an end, edges from a node to itself, confidences out of range, nodes given twice, features without geometry, operations without features."""
    row = lambda d, problem, a, b=None: d.select(F.lit(problem).alias("problem"), F.col(a).alias("node_id"), (F.col(b) if b else F.lit(None)).cast("string").alias("other"))
    loose = row(dangling(edges, nodes), "edge_without_end", "src", "dst")
    twice = nodes.groupBy("node_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("graph_id", "node_type").alias("k")).where("k > 1")
    wrong = nodes.where(~F.col("confidence").between(0.0, 1.0)).select("node_id").distinct()
    empty = lambda kind: nodes.where(F.col("node_type") == kind).select("node_id").distinct().join(edges.select(F.col("src").alias("node_id")), "node_id", "left_anti")
    parts = [row(self_loops(edges), "edge_to_itself", "src", "dst"), row(wrong, "confidence_out_of_range", "node_id"), row(twice, "node_given_twice", "node_id"), row(empty("feature"), "feature_without_geometry", "node_id"), row(empty("operation"), "operation_without_feature", "node_id")]
    out = loose
    for p in parts:
        out = out.unionByName(p)
    return out.distinct()


def node_features(holes: DataFrame) -> DataFrame:
    """Numbers a model takes of each node: shares of the largest area and perimeter, clamped place in the panel, one-hot layer types."""
    from kerfspark.functions import geometry as g
    from kerfspark.functions.layers import layer_type

    d, w, h = F.col("diameter"), F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin")
    per_panel = Window.partitionBy("panel_id")
    clamp = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    kind = layer_type(F.col("layer"))
    one = lambda *k: kind.isin(*k).cast("double")
    return holes.select(
        "panel_id",
        "seq",
        (d * d / F.max(d * d).over(per_panel)).alias("area_share"),
        (d / F.max(d).over(per_panel)).alias("perimeter_share"),
        F.least(d / 100, F.lit(2.0)).alias("size"),
        clamp((F.col("x") - F.col("xmin")) / w).alias("px"),
        clamp((F.col("y") - F.col("ymin")) / h).alias("py"),
        one("cut", "border").alias("is_cut"),
        one("drill").alias("is_drill"),
        one("pocket").alias("is_pocket"),
        one("engrave", "unknown").alias("is_other"),
        clamp(F.greatest(F.lit(0.0), g.edge_distance(F.col("x"), F.col("y"))) / F.greatest(w, h)).alias("edge_share"),
    )


FEATURES = ["area_share", "perimeter_share", "log_aspect", "roundness", "size", "is_circle", "is_closed", "is_outer", "px", "py", "is_cut", "is_drill", "is_pocket", "is_other", "contained", "edge_share"]


def shape_features(shapes: DataFrame) -> DataFrame:
    """(panel_id, node, the 16 FEATURES): what a model takes of every shape of ``rules.with_panel``; what a shape lacks is 0. The panel's largest measures come by a join that a hot panel doesn't slow."""
    c = F.col
    most = shapes.groupBy("panel_id").agg(F.max("area").alias("_a"), F.max("perimeter").alias("_p"))
    s = lookup(shapes, most, "panel_id", "node")
    w, h = c("xmax") - c("xmin"), c("ymax") - c("ymin")
    bw, bh = c("bx1") - c("bx0"), c("by1") - c("by0")
    clamp = lambda x, lo=0.0, hi=1.0: F.least(F.greatest(x, F.lit(lo)), F.lit(hi))
    share = lambda x, m: F.when(c(m) > 0, F.coalesce(x, F.lit(0.0)) / c(m)).otherwise(0.0)
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("double")
    circle = c("geometry_type") == "circle"
    edge = F.least(c("x") - c("xmin"), c("xmax") - c("x"), c("y") - c("ymin"), c("ymax") - c("y"))
    values = [
        share(c("area"), "_a"), share(c("perimeter"), "_p"), F.when((bw > 0) & (bh > 0), clamp(F.log10(bw / bh), -2.0, 2.0)).otherwise(0.0), F.when(c("perimeter") > 0, clamp(4 * 3.141592653589793 * F.coalesce("area", F.lit(0.0)) / (c("perimeter") * c("perimeter")))).otherwise(0.0),
        F.when(circle & c("radius").isNotNull(), F.least(2 * c("radius") / 100, F.lit(2.0))).otherwise(0.0), flag(circle), flag(c("is_closed")), flag(c("is_boundary")), F.when(w > 0, clamp((c("x") - c("xmin")) / w)).otherwise(0.0), F.when(h > 0, clamp((c("y") - c("ymin")) / h)).otherwise(0.0),
        flag(c("kind").isin("cut", "border")), flag(c("kind") == "drill"), flag(c("kind") == "pocket"), flag(~c("kind").isin("cut", "border", "drill", "pocket")), F.lit(0.0), F.when(F.greatest(w, h) > 0, clamp(F.greatest(F.lit(0.0), edge) / F.greatest(w, h))).otherwise(0.0),
    ]
    return s.select("panel_id", "node", *[F.coalesce(v, F.lit(0.0)).alias(n) for n, v in zip(FEATURES, values)])


def edge_index(shapes: DataFrame, edges: DataFrame) -> DataFrame:
    """(panel_id, src, dst) for a model: edges (panel_id, a, b) between shapes in both directions, and each shape with itself."""
    own = shapes.select("panel_id", F.col("node").alias("src"), F.col("node").alias("dst"))
    ends = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return own.unionByName(edges.select("panel_id", F.explode(ends).alias("_e")).select("panel_id", "_e.*")).distinct()


def index_split(ids: DataFrame, ident: str) -> DataFrame:
    """Split of an id by its last run of digits: of a hundred, 70 train, 15 val, 15 test; ids without digits by hash."""
    n = F.coalesce(F.regexp_extract(ident, r"(\d+)\D*$", 1).try_cast("bigint"), F.pmod(F.xxhash64(ident), F.lit(100))) % 100
    return ids.select(ident, F.when(n < 70, "train").when(n < 85, "val").otherwise("test").alias("split"))


def split_clashes(samples: DataFrame, ident: str, split: str) -> DataFrame:
    """Ids that stand in more than one split."""
    return samples.where(F.col(split).isNotNull()).groupBy(ident).agg(F.countDistinct(split).alias("splits")).where("splits > 1")


def nest_layouts(panels: DataFrame) -> DataFrame:
    """Of each layout: panels, used area and the share of its covering box."""
    b = lambda i: F.col("bounding_box")[i]
    p = panels.dropDuplicates(["panel_id"]).where(F.size("bounding_box") == 4)
    by = p.groupBy("layout_id").agg(F.count(F.lit(1)).alias("panels"), F.sum("area_mm2").alias("used"), F.min(b(0)).alias("x0"), F.min(b(1)).alias("y0"), F.max(b(2)).alias("x1"), F.max(b(3)).alias("y1"))
    return by.select("layout_id", "panels", "used", (F.col("used") / ((F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0")))).alias("utilisation"))


def nest_overlaps(panels: DataFrame) -> DataFrame:
    """Pairs a < b of a layout's panels whose boxes share area: an equi-join over cells, each pair counted in the cell of its overlap's corner."""
    cell = 1000.0
    b = lambda i: F.col("bounding_box")[i]
    p = panels.dropDuplicates(["panel_id"]).where(F.size("bounding_box") == 4).select("layout_id", "panel_id", b(0).alias("x0"), b(1).alias("y0"), b(2).alias("x1"), b(3).alias("y1"))
    span = lambda a, z: F.sequence(F.floor(F.col(a) / cell), F.floor(F.greatest(F.col(a), F.col(z)) / cell))
    cells = p.withColumn("cx", F.explode(span("x0", "x1"))).withColumn("cy", F.explode(span("y0", "y1")))
    side = lambda s: cells.select("layout_id", "cx", "cy", *[F.col(c).alias(f"{c}_{s}") for c in ("panel_id", "x0", "y0", "x1", "y1")])
    m = side("a").join(side("b"), ["layout_id", "cx", "cy"]).where("panel_id_a < panel_id_b")
    lo = lambda c: F.greatest(f"{c}_a", f"{c}_b")
    w, h = F.least("x1_a", "x1_b") - lo("x0"), F.least("y1_a", "y1_b") - lo("y0")
    here = (F.floor(lo("x0") / cell) == F.col("cx")) & (F.floor(lo("y0") / cell) == F.col("cy"))
    return m.where((w > 0) & (h > 0) & here).select("layout_id", F.col("panel_id_a").alias("panel_a"), F.col("panel_id_b").alias("panel_b"), (w * h).alias("overlap"))


def to_cytoscape(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON text an element; nodes with their fields, their type by any of the tables' names, and their position."""
    at = F.when(F.size("centroid") >= 2, F.struct(F.col("centroid")[0].alias("x"), F.col("centroid")[1].alias("y")))
    kind = F.coalesce("geometry_type", "feature_class", "operation_type").alias("type")
    data = F.struct(F.col("node_id").alias("id"), kind, *[c for c in nodes.columns if c != "node_id"])
    n = nodes.select(F.lit("nodes").alias("part"), F.col("node_id").alias("id"), F.to_json(F.struct(data.alias("data"), at.alias("position"))).alias("element"))
    e = edges.select("src", "dst").distinct().select(F.lit("edges").alias("part"), F.concat_ws("->", "src", "dst").alias("id"), F.to_json(F.struct(F.struct(F.col("src").alias("source"), F.col("dst").alias("target")).alias("data"))).alias("element"))
    return n.unionByName(e)
