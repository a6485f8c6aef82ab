"""Command line: python -m geoframe VERB INPUT [OUTPUT] [options]."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import SparkSession

from .frame import GeoFrame
from .plans import checks, fixes, metadata


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="geoframe", description=__doc__)
    sub = p.add_subparsers(dest="verb", required=True)

    def verb(verb_: str, *, output: bool = True, **options):
        v = sub.add_parser(verb_)
        v.add_argument("input")
        if output:
            v.add_argument("output")
            v.add_argument("--overwrite", action="store_true")
            v.add_argument("--dry-run", action="store_true", help="print the plan, write nothing")
        for k, given in options.items():
            v.add_argument(f"--{k.replace('_', '-')}", **given)

    verb("extract", columns={}, exclude_columns={}, bbox={}, geometry={}, where={}, limit={"type": int})
    verb("add-bbox", name={"default": "bbox"}, force={"action": "store_true"})
    verb("add-quadkey", resolution={"type": int, "default": 13}, use_centroid={"action": "store_true"})
    verb("add-kdtree", iterations={"type": int, "default": 9})
    verb("sort-hilbert")
    verb("sort-quadkey", resolution={"type": int, "default": 13})
    verb("sort-column", columns={"required": True}, descending={"action": "store_true"})
    verb("reproject", target_crs={"default": "EPSG:4326"}, source_crs={})
    verb("convert", delimiter={}, wkt_column={}, lat_column={}, lon_column={}, skip_invalid={"action": "store_true"}, hilbert={"action": "store_true"}, bbox={"action": "store_true"}, crs={})
    verb("fix", output=False, to={})
    verb("partition", column={"required": True}, chars={"type": int}, hive={"action": "store_true"}, force={"action": "store_true"})
    verb("inspect", output=False)
    verb("check", output=False)
    verb("validate", output=False)
    return p


def main(args: list[str] | None = None) -> int:
    a = vars(parser().parse_args(args))
    verb, path = a.pop("verb"), a.pop("input")
    if verb in ("fix", "check"):
        spark = SparkSession.builder.appName("geoframe").getOrCreate()
        done, found = fixes.fix_file(spark, path, a["to"]) if verb == "fix" else ([], checks.check_path(spark, path))
        print("\n".join([*(f"fixed  {x}" for x in done), *(f"{'ok' if c else 'no'}  {c.name}: {'; '.join(c.failures + c.warnings) or 'fine'}" for c in found)]))
        return int(not all(found))
    if verb in ("inspect", "validate"):
        info = metadata.file_info(path)
        if verb == "inspect":
            print(json.dumps(info, indent=2))
            return 0
        rules = metadata.validate_native(path) if metadata.file_kind(info) == "native" else metadata.validate(info)
        print("\n".join(f"{'ok' if kept else 'no'}  {name}{': ' + why if why else ''}" for name, kept, why in rules))
        return int(not all(kept for _, kept, _ in rules))
    output, overwrite, dry_run = a.pop("output"), a.pop("overwrite"), a.pop("dry_run")
    if sys.stdout.isatty() and output == "-":
        raise SystemExit("an Arrow stream isn't for a terminal: send it to a file or another program")
    spark = SparkSession.builder.appName("geoframe").getOrCreate()
    options = {k: v for k, v in a.items() if v is not None}
    if verb == "convert":
        hilbert, bbox = options.pop("hilbert"), options.pop("bbox")
        frame = GeoFrame.read(spark, path, **{k: v for k, v in options.items() if v})
        frame = frame.add_bbox() if bbox else frame
        frame = frame.sort_hilbert() if hilbert else frame
    elif path == "-":
        frame = GeoFrame.read_ipc(spark, sys.stdin.buffer)
    else:
        frame = GeoFrame.read(spark, path)
    if verb == "partition":
        print(frame.partition_by_string(output, options.pop("column"), overwrite=overwrite, **options))
        return 0
    if verb == "extract":
        for k in ("columns", "exclude_columns"):
            if k in options:
                options[k] = options[k].split(",")
        frame = frame.extract(**options)
    elif verb == "add-bbox":
        frame = frame.add_bbox(options["name"], force=options["force"])
    elif verb == "sort-column":
        frame = frame.sort_column(options["columns"], options["descending"])
    elif verb != "convert":
        frame = getattr(frame, verb.replace("-", "_"))(**options)
    if dry_run:
        print(frame.explain())
    elif output == "-":
        frame.write_ipc(sys.stdout.buffer)
    else:
        frame.write(output, overwrite=overwrite)
    return 0


if __name__ == "__main__":
    raise SystemExit(main())
