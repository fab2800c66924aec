"""python -m pixelweft fill|mesh IMAGES [OUTPUT] [--config FILE] [--OPTION VALUE ...]

Without OUTPUT the result lies beside IMAGES, with the plan's name as a suffix. `batch_stripe_distance` of older
configuration files is read and not used: Spark deals pixels over tasks.
"""

from __future__ import annotations

import argparse
from dataclasses import fields, replace

from pyspark.sql import SparkSession

from pixelweft.plans import pipeline
from pixelweft.sources.images import Options, default_output, read_images, to_png


def main(args: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    p.add_argument("plan", choices=["fill", "mesh"])
    p.add_argument("images")
    p.add_argument("output", nargs="?")
    p.add_argument("--config")
    for f in (f for f in fields(Options) if f.name != "batch_stripe_distance"):
        p.add_argument(f"--{f.name}", type=type(f.default))
    a = p.parse_args(args)
    o = replace(Options.load(a.config), **{f.name: v for f in fields(Options) if (v := getattr(a, f.name, None)) is not None})
    spark = SparkSession.builder.getOrCreate()
    pixels = read_images(spark, a.images)
    out = to_png(pipeline.gradient_fill(pixels, o)) if a.plan == "fill" else pipeline.mesh_quads(pixels, o)
    out.write.parquet(a.output or default_output(a.images, f"_{a.plan}"))


if __name__ == "__main__":
    main()
