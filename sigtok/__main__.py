"""Command line: encode, decode, info, ls."""

from __future__ import annotations

import argparse
import sys

from sigtok.errors import EXIT_CANCELLED, EXIT_OK, SigtokError, UsageError


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sigtok", description="Tokenize signals and bring them back.")
    commands = top.add_subparsers(dest="command", required=True)
    for name, about in (("encode", "Parquet reads to a token file"), ("decode", "a token file to Parquet reads")):
        c = commands.add_parser(name, help=about)
        c.add_argument("source")
        c.add_argument("-o", "--output", required=True)
        c.add_argument("--codec", default="mean-quant")
        c.add_argument("--batch-size", type=int, default=64)
        c.add_argument("--force", action="store_true")
        c.add_argument("-v", "--verbose", action="store_true")
        c.add_argument("--master", default="local[*]")
    info = commands.add_parser("info", help="the profile, or a token file's header")
    info.add_argument("file", nargs="?")
    commands.add_parser("ls", help="the codecs there are")
    return top


def run(args: argparse.Namespace) -> int:
    from sigtok.operators import codecs

    if args.command == "ls":
        for name, about in codecs.listed().items():
            print(f"{name}\t{about}")
    elif args.command == "info":
        from sigtok.profile import PROFILE
        from sigtok.sources.tokens import read_header

        data = read_header(args.file).to_json_dict() if args.file else PROFILE.to_json_dict()
        for name, value in data.items():
            print(f"{name}\t{value}")
    else:
        if args.batch_size < 1:
            raise UsageError("the batch size must be at least 1")
        if args.codec not in codecs.listed():
            raise UsageError(f"no codec {args.codec!r}", "sigtok ls shows what there is")
        from sigtok.plans.pipeline import decode_file, encode_file
        from sigtok.session import build

        spark = build(args.master)
        try:
            if args.command == "encode":
                report = encode_file(spark, args.source, args.output, args.codec, force=args.force, batch=args.batch_size)
            else:
                report = decode_file(spark, args.source, args.output, args.codec, args.force)
            row = report.first().asDict()
            print(", ".join(f"{v} {k}" for k, v in row.items()))
        finally:
            spark.stop()
    return EXIT_OK


def main(argv: list[str] | None = None) -> int:
    try:
        return run(parser().parse_args(argv))
    except SystemExit as e:
        return int(e.code or 0)
    except KeyboardInterrupt:
        return EXIT_CANCELLED
    except SigtokError as e:
        print(f"sigtok: {e}" + (f"\n  {e.hint}" if e.hint else ""), file=sys.stderr)
        return e.exit_code


if __name__ == "__main__":
    sys.exit(main())
