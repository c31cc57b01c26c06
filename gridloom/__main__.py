"""Command line: python -m gridloom COMMAND CATALOG ..."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.colors import ColorScale
from .operators import aggregate, local
from .plans.engine import Engine
from .runtime import clean_scratch
from .sources import images
from .sources.catalog import Catalog
from .sources.vectors import feature_bounds


def main(argv: list[str] | None = None, spark: SparkSession | None = None):
    p = argparse.ArgumentParser(prog="gridloom")
    p.add_argument("command", choices=["mapalgebra", "ingest", "export", "buildpyramid", "quantiles", "calcstats", "findholes", "info", "vectorinfo", "tags", "generatekeys", "list", "colorscale", "printsplits", "showconf", "cleancache"])
    p.add_argument("catalog")
    p.add_argument("name", nargs="?")
    p.add_argument("-e", "--expression")
    p.add_argument("-o", "--output")
    p.add_argument("-i", "--input")
    p.add_argument("-n", "--number", type=int, default=4)
    p.add_argument("-z", "--zoom", type=int)
    p.add_argument("-a", "--aggregator")
    p.add_argument("-f", "--format", default="tif")
    p.add_argument("-t", "--tag", action="append", default=[])
    p.add_argument("-b", "--buildpyramid", action="store_true")
    p.add_argument("--tilesize", type=int, default=512)
    p.add_argument("--categorical", action="store_true")
    p.add_argument("--nodata", type=float)
    p.add_argument("--skip-categories", action="store_true")
    p.add_argument("--protection", default="")
    p.add_argument("--all-levels", action="store_true")
    p.add_argument("--single", action="store_true")
    p.add_argument("--max-size", default="")
    p.add_argument("--older", type=float, default=24.0, help="hours that a scratch folder must be old to be deleted")
    p.add_argument("--local", action="store_true", help="run in this process")
    p.add_argument("--executors", type=int)
    p.add_argument("--cores", type=int)
    p.add_argument("--memory")
    a = p.parse_args(argv)
    if spark is None:
        b = SparkSession.builder.appName("gridloom")
        b = b.master(f"local[{a.cores or '*'}]") if a.local else b
        for key, value in {"spark.executor.instances": a.executors, "spark.executor.cores": a.cores, "spark.executor.memory": a.memory}.items():
            b = b.config(key, value) if value else b
        spark = b.getOrCreate()
    c = Catalog(spark, a.catalog)
    if a.command == "list":
        out = {"rasters": c.rasters(), "vectors": c.vectors()}
    elif a.command == "mapalgebra":
        got = Engine(spark, c).run(a.expression)
        saved = c.save(got, a.name)
        if a.buildpyramid:
            c.save(aggregate.build_pyramid(saved, a.aggregator), a.name)
        out = a.name
    elif a.command == "ingest":
        c.save(images.ingest(a.input, a.zoom, nodata=a.nodata, categorical=a.categorical, skip_categories=a.skip_categories, protection=a.protection, tilesize=a.tilesize, spark=spark), a.name)
        out = a.name
    elif a.command == "export":
        out = images.export(c.raster(a.name, a.zoom), a.output, format=a.format, single=a.single, all_levels=a.all_levels, max_size=a.max_size)
    elif a.command == "buildpyramid":
        c.save(aggregate.build_pyramid(c.raster(a.name), a.aggregator), a.name)
        out = sorted(c.meta(a.name))
    elif a.command == "quantiles":
        q = aggregate.with_quantiles(c.raster(a.name), a.number).meta.quantiles
        c.set_quantiles(a.name, q)
        out = [(band, k + 1, v) for band, values in enumerate(q) for k, v in enumerate(values)]
    elif a.command == "calcstats":
        out = c.restate(a.name)
    elif a.command == "findholes":
        out = sorted(x.tile_id for x in local.find_holes(c.raster(a.name, a.zoom)).collect())
    elif a.command == "generatekeys":
        out = sorted(x.tile_id for x in c.raster(a.name, a.zoom).tiles().select("tile_id").distinct().orderBy("tile_id").limit(a.number).collect())
    elif a.command == "tags":
        c.tag(a.name, **dict(x.split("=", 1) for x in a.tag))
        out = [m.tags for m in c.meta(a.name).values()]
    elif a.command == "vectorinfo":
        f = c.features(a.name)
        b = feature_bounds(f)
        out = {"columns": f.columns, "features": f.count(), "bounds": None if b is None else [b.w, b.s, b.e, b.n], "attributes": sorted(r[0] for r in f.select(F.explode(F.map_keys("attrs"))).distinct().collect())}
    elif a.command == "colorscale":
        if a.input:
            with open(a.input) as f:
                c.add_color_scale(a.name, ColorScale.from_json(f.read()))
        out = c.color_scales()
    elif a.command == "printsplits":
        out = c.splits(a.name, a.zoom)
    elif a.command == "showconf":
        out = dict(sorted(spark.sparkContext.getConf().getAll()))
    elif a.command == "cleancache":
        out = clean_scratch(spark, a.older)
    else:
        out = {z: json.loads(m.to_json()) for z, m in c.meta(a.name).items()}
    print(json.dumps(out, default=str))
    return out


if __name__ == "__main__":
    main()
