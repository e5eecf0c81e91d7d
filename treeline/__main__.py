"""Command line: run, validate, methods, version. Exit codes: 0 fine, 1 wrong use, 2 a route failed."""

from __future__ import annotations

import argparse
import sys

from . import __version__


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="treeline")
    sub = parser.add_subparsers(dest="command")
    run = sub.add_parser("run")
    run.add_argument("--config", required=True)
    run.add_argument("--input", action="append", default=[])
    run.add_argument("--output", required=True)
    sub.add_parser("validate").add_argument("config")
    sub.add_parser("methods")
    sub.add_parser("version")
    try:
        args = parser.parse_args(argv)
    except SystemExit as e:
        return 1 if e.code else 0
    from .plans import pipeline

    if args.command == "version":
        print(__version__)
    elif args.command == "methods":
        for name, method in pipeline.methods().items():
            print(name, method.manifest.version, ",".join(method.manifest.accepts))
    elif args.command == "validate":
        try:
            with open(args.config, encoding="utf-8") as f:
                print(f"{len(pipeline.parse(f.read()))} nodes")
        except (ValueError, OSError) as e:
            print(e, file=sys.stderr)
            return 1
    elif args.command == "run":
        from pyspark.sql import SparkSession
        from pyspark.sql import functions as F

        from .sources import files, parsers

        spark = SparkSession.builder.appName("treeline").getOrCreate()
        sequences = trees = None
        if args.input:
            found = files.discover(spark, *args.input)
            stem = files.stem_of(F.col("path")).alias("dataset")
            text = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(args.input).select("path", F.decode("content", "UTF-8").alias("text"))
            of = lambda kind: text.join(found.filter(F.col("kind") == kind), "path", "left_semi")
            sequences = parsers.read_fasta(of("alignment")).select(stem, "name", "sequence")
            trees = of("tree").select(stem, F.col("text").alias("newick"))
        with open(args.config, encoding="utf-8") as f:
            signals, failed = pipeline.run(spark, f.read(), sequences, trees)
        pipeline.write_reports(signals, args.output)
        for line in failed:
            print(line, file=sys.stderr)
        return 2 if failed else 0
    else:
        parser.print_help()
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
