"""python -m kerfspark list | run NAME FOLDER OUT | analyze DRAWINGS OUT | nest DRAWINGS OUT | generate N SEED OUT | ingest DRAWINGS OUT | dataset DRAWINGS OUT | profiles

``run`` writes a query's rows over a folder of tables; the other commands work on folders of drawing files. Results are Parquet.
"""

from __future__ import annotations

import sys


def queries() -> dict:
    """The queries of every module of the package that has some."""
    import importlib
    import pkgutil

    import kerfspark

    found: dict = {}
    for m in pkgutil.walk_packages(kerfspark.__path__, "kerfspark."):
        if m.name.rsplit(".", 1)[1] in ("problems", "reference", "queries"):
            found |= importlib.import_module(m.name).QUERIES
    return found


def analyze(spark, folder: str):
    from kerfspark.plans import analysis
    from kerfspark.sources import dxf

    return analysis.analyze(dxf.read_dxf(spark, folder))


def nest(spark, folder: str):
    from kerfspark.operators import nesting
    from kerfspark.plans import analysis
    from kerfspark.runtime import cut
    from kerfspark.sources import dxf

    return nesting.layouts(cut(analysis.nest_shapes(dxf.entities(dxf.read_dxf(spark, folder)))))


def ingest(spark, folder: str):
    from kerfspark.sources import dxf

    return dxf.entities(dxf.read_dxf(spark, folder))


def dataset(spark, folder: str):
    from kerfspark.operators import classify, dataset, rules
    from kerfspark.plans import analysis
    from kerfspark.runtime import cut
    from kerfspark.sources import dxf

    shapes = cut(analysis.shapes(cut(dxf.entities(dxf.read_dxf(spark, folder)))))
    found = cut(rules.findings(shapes))
    report = cut(rules.report(shapes, found))
    return dataset.documents(dataset.labels(shapes, classify.nodes(shapes), report), report, rules.results(shapes, found))


FOLDERS = {"analyze": analyze, "nest": nest, "ingest": ingest, "dataset": dataset}


def main(args: list[str]) -> int:
    if args[:1] == ["list"]:
        print("\n".join(sorted(queries())))
        return 0
    if args[:1] == ["profiles"]:
        from kerfspark.functions.layers import LAYER_PREFIXES

        print("\n".join(f"{kind}: {', '.join(of)}" for kind, of in LAYER_PREFIXES.items()))
        return 0
    good = (len(args) == 4 and args[0] in ("run", "generate")) or (len(args) == 3 and args[0] in FOLDERS)
    if not good or (args[0] == "run" and args[1] not in queries()):
        print(__doc__)
        return 2
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName(f"kerfspark {' '.join(args[:2])}").getOrCreate()
    if args[0] == "run":
        rows = queries()[args[1]](spark, args[2])
    elif args[0] == "generate":
        from kerfspark.operators import synth

        rows = synth.gated(synth.generate(spark, int(args[1]), int(args[2])))
    else:
        rows = FOLDERS[args[0]](spark, args[1])
    rows.write.mode("errorifexists").parquet(args[-1])
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
