"""python -m rastrel trace|auto|score|gen|inspect|bench"""

from __future__ import annotations

import argparse
import json
import pathlib
import sys

from .config import PRESETS, Config, format_for


def session(cores: str):
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.master(f"local[{cores}]").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


SMOOTH = (3, 4.0)


def chosen(args) -> Config:
    """The preset with only what the command line gave; a preset's own settings stay otherwise."""
    cfg = PRESETS[args.preset]
    given = {"segment__colors": args.colors, "segment__despeckle_area": args.despeckle, "fit__tolerance": args.tolerance, "corners__smoothing": args.smoothing, "output__precision": args.precision, "output__scale": args.scale}
    cfg = cfg.with_(**{k: v for k, v in given.items() if v is not None})
    cfg = cfg.with_(output__recolor_regions=True) if args.recolor else cfg
    return cfg.with_(segment__transparent=tuple(args.transparent)) if args.transparent else cfg


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="rastrel", description=__doc__)
    parser.add_argument("--cores", default="*")
    commands = parser.add_subparsers(dest="command", required=True)
    settings = argparse.ArgumentParser(add_help=False)
    settings.add_argument("--preset", choices=sorted(PRESETS), default="clipart")
    for name, kind in (("colors", int), ("despeckle", int), ("tolerance", float), ("smoothing", float), ("precision", int), ("scale", float)):
        settings.add_argument(f"--{name}", type=kind)
    settings.add_argument("--recolor", action="store_true")
    settings.add_argument("--transparent", nargs="*", metavar="#rrggbb")
    for name in ("trace", "auto"):
        p = commands.add_parser(name, parents=[settings])
        p.add_argument("image")
        p.add_argument("-o", "--output", required=True)
        p.add_argument("--target", type=float, default=99.0)
        if name == "auto":
            p.add_argument("--max-side", type=int, default=0, help="search on a copy no larger than this")
            p.add_argument("--smooth", action="store_true", help="measure against the smoothed original, for JPEG damage")
    p = commands.add_parser("score")
    p.add_argument("image")
    p.add_argument("vector")
    p.add_argument("--threshold", type=float, default=2.0)
    p.add_argument("--smooth", action="store_true", help="measure against the smoothed original, for JPEG damage")
    commands.add_parser("gen").add_argument("folder")
    commands.add_parser("inspect").add_argument("image")
    commands.add_parser("bench", parents=[settings]).add_argument("--auto", action="store_true", help="search each image's settings")
    args = parser.parse_args(argv)
    if args.command == "gen":
        from .kernels import paint
        from .sources import scenes

        folder = pathlib.Path(args.folder)
        folder.mkdir(parents=True, exist_ok=True)
        for s in scenes.SUITE:
            if s.svg():
                (folder / f"{s.name}.svg").write_text(s.svg())
            (folder / f"{s.name}.png").write_bytes(paint.png(paint.rasterise(s.svg(), s.supersample) if s.svg() else s.make()))
        return 0
    from .kernels import paint
    from .plans import report, trace
    from .sources import pixels

    spark = session(args.cores)
    if args.command == "bench":
        rows = report.suite(spark, None if args.auto else chosen(args)).cache()
        rows.orderBy("place").drop("place").show(50, False)
        report.summary(rows).show(1, False)
        return 0
    known = pathlib.PurePath(args.image).suffix.lower() in (".png", ".jpg", ".jpeg", ".gif", ".bmp")
    images = pixels.read_images(spark, args.image) if known else pixels.read_files(spark, args.image)
    one = lambda: trace.unpacked(*(lambda r: (r["width"], r["height"], bytes(r["data"])))(images.first()))
    if args.command == "score":
        original = trace.reference(one(), Config(), SMOOTH if args.smooth else None)
        found = paint.compare(original, paint.rasterise(pathlib.Path(args.vector).read_text()), args.threshold)
        print(report.metrics_text(found, args.threshold))
    elif args.command == "inspect":
        image = one()
        print(json.dumps({"height": image.shape[0], "width": image.shape[1], "key": report.suggested_key(image), **trace.profile_of(image)}, default=lambda v: v.item()))
    else:
        cfg = chosen(args).with_(output__format=format_for(args.output))
        if args.command == "auto":
            found = [r.asDict() for r in trace.auto_select(images, args.target, max_side=args.max_side, smooth=SMOOTH if args.smooth else None, transparent=cfg.segment.transparent).orderBy("place").collect()]
            print(report.candidates_text(found, args.target))
            cfg = Config.from_json(found[0]["config"]).with_(output__format=cfg.output.format)
        row = trace.trace(images, {"cli": cfg}).first()
        pathlib.Path(args.output).write_bytes(bytes(row["content"]))
        print(f"{args.output}: {row['shapes']} shapes, {row['points']} points")
    return 0


if __name__ == "__main__":
    sys.exit(main())
