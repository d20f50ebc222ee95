"""``python -m skeinlake convert IN.warc OUT.wacz``: 0 done, 1 done with warnings, 2 failed."""

from __future__ import annotations

import argparse
import sys


def main(argv: list[str] | None = None) -> int:
    top = argparse.ArgumentParser(prog="skeinlake")
    convert = top.add_subparsers(dest="command", required=True).add_parser("convert")
    convert.add_argument("source")
    convert.add_argument("dest")
    convert.add_argument("--no-gzip", action="store_true", help="keep a plain source plain")
    convert.add_argument("--gzip-level", type=int, default=6)
    convert.add_argument("--zip-level", type=int, default=6)
    convert.add_argument("--zipnum-lines", type=int)
    a = top.parse_args(argv)
    from skeinlake.session import build_session
    from skeinlake.sinks.convert import Conversion
    from skeinlake.sinks.package import WriterOptions

    try:
        options = WriterOptions(gzip_level=a.gzip_level, zip_level=a.zip_level, zipnum_lines=a.zipnum_lines)
        done = Conversion(build_session(), a.source, a.dest, options, gzip_warc=not a.no_gzip).run()
    except Exception as e:  # noqa: BLE001 - the exit code says it
        print(e, file=sys.stderr)
        return 2
    print(f"{done.records} records, {done.captures} captures, {done.pages} pages")
    for code, detail in done.warnings:
        print(f"{code} {detail}", file=sys.stderr)
    return 1 if done.warnings else 0


if __name__ == "__main__":
    sys.exit(main())
