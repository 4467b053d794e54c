"""python -m glyphmill norm [IN [OUT]] | ana [IN] | tables OUT: the programs on files, directories or standard input."""

from __future__ import annotations

import argparse
import json
import sys
from itertools import chain, islice

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphmill.api import Normalizer
from glyphmill.functions import tables
from glyphmill.operators import changelog, normalize, summary, tags
from glyphmill.plans import analysis, cases, documents
from glyphmill.sources import text


def names(given: str | None) -> list[str]:
    """A comma-separated list; unknown steps are an error."""
    out = [x.strip() for x in (given or "").split(",") if x.strip()]
    if unknown := set(out) - {*normalize.NAMES, "del-surrogate"}:
        raise SystemExit(f"unknown steps: {', '.join(sorted(unknown))}")
    return out


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="glyphmill")
    sub = p.add_subparsers(dest="program", required=True)
    n = sub.add_parser("norm")
    a = sub.add_parser("ana")
    t = sub.add_parser("tables")
    for s in (n, a):
        s.add_argument("path", nargs="?", default="-", help="a file or directory; - for standard input")
        s.add_argument("--glob")
        s.add_argument("--lc", default="")
    n.add_argument("out", nargs="?", default="-", help="a directory to write; - for standard output")
    for flag in ("--skip", "--add", "--only", "--all-except"):
        n.add_argument(flag)
    n.add_argument("--all", action="store_true")
    n.add_argument("--look-alikes", metavar="FILE", help="rows for the step look-alike instead of the built-in ones")
    n.add_argument("--mapping", metavar="FILE", help="a table of characters looked up after all steps")
    n.add_argument("-v", "--verbose", action="store_true")
    a.add_argument("--json", metavar="OUT", help="the sections as rows of JSON")
    a.add_argument("--document", action="store_true", help="the nested document instead of the report")
    a.add_argument("--summary", action="store_true")
    a.add_argument("--tags", action="store_true", help="the report of issue tags")
    a.add_argument("--all-tags", action="store_true")
    a.add_argument("--ref-ids", metavar="FILE", help="ids of the lines")
    a.add_argument("--max-cases", type=int, default=100)
    a.add_argument("--max-examples", type=int, default=5)
    t.add_argument("out", help="a directory: one table each, and where they depart from form KC")
    args = p.parse_args(argv)
    spark = SparkSession.builder.appName("glyphmill").getOrCreate()
    return {"norm": norm, "ana": ana, "tables": write_tables}[args.program](spark, args)


def conflicts(args: argparse.Namespace) -> list[str]:
    """What contradicts itself among the options, and what is done about it."""
    out = []
    if args.all and args.all_except:
        out.append("--all is ignored because of --all-except")
    if args.only and args.all_except:
        out.append("--only is taken as --add because of --all-except")
    elif args.only and args.all:
        out.append("--only is ignored because of --all")
    both = [x for x in names(args.add) + names(args.only) if x in names(args.skip) + names(args.all_except)]
    if both:
        out.append(f"steps both to be done and not to be done are done: {', '.join(both)}")
    return out


def steps_of(args: argparse.Namespace) -> frozenset[str]:
    base = "all" if args.all or args.all_except else "none" if args.only else "default"
    return normalize.chosen(base, add=names(args.add) + names(args.only), skip=names(args.skip) + names(args.all_except))


def lines_of(spark: SparkSession, args: argparse.Namespace, **options) -> DataFrame:
    return text.read_stdin(spark, **options) if args.path == "-" else text.read_lines(spark, args.path, args.glob, **options)


def norm(spark: SparkSession, args: argparse.Namespace) -> int:
    for warning in conflicts(args):
        print(f"Warning: {warning}", file=sys.stderr)
    steps = steps_of(args)
    n = Normalizer("none", steps, lang=args.lc, look_alikes=text.read_look_alikes(spark, args.look_alikes) if args.look_alikes else None, table=text.mapping_of(spark, args.mapping) if args.mapping else None)
    # Ill-formed bytes are read as Windows-1252 by one step; what is left of them goes, by del-surrogate or as it can't be written.
    lines = lines_of(spark, args, repair="repair-encoding-errors" in steps)
    if args.path == "-":
        lines = lines.persist()
    done = n.table_of(lines)
    if args.out == "-":
        for r in done.orderBy("doc_id", "line_no").select("text").toLocalIterator():
            print(r.text)
    else:
        text.write_lines(done, args.out)
    if args.verbose:
        if "look-alike" in steps:
            for r in n.unchanged_words(lines).collect():  # a hundred at most
                print(f"   unchanged mixed token: {r.word} ({r.n})", file=sys.stderr if args.out == "-" else sys.stdout)
        print(changelog.printed(n.log(lines)), file=sys.stderr if args.out == "-" else sys.stdout)
    return 0


def ana(spark: SparkSession, args: argparse.Namespace) -> int:
    lines = lines_of(spark, args, strip=False, keep_raw=True)
    if args.path == "-":
        lines = lines.persist()
    if args.tags or args.all_tags:
        rows = lines.withColumnRenamed("text", "line")
        full = rows.select(tags.collapsed(F.col("line")).alias("line"))
        size = full.agg(F.count("*").alias("lines"), F.coalesce(F.sum(F.when(F.col("line") != "", F.size(F.split("line", " ")))), F.lit(0)).alias("tokens")).first()
        print(tags.printed(tags.issues(rows, args.lc, raw_col="raw"), args.lc, args.all_tags, n_tokens=size.tokens, n_lines=size.lines), end="")
        return 0
    if args.summary:
        found = summary.by_document(text.without_range_lines(lines.drop("raw"))).where("issues <> ''")
        for r in found.select("doc_id", F.array_join(F.array_sort(F.split("issues", "; ")), "; ").alias("issues")).orderBy("doc_id").toLocalIterator():
            print(f"{r.doc_id}: {r.issues}")
        return 0
    if args.json:
        text.write_json(analysis.as_json(text.without_range_lines(lines.drop("raw")), "line_no"), args.json)
        return 0
    refs = text.read_ref_ids(spark, args.ref_ids).persist() if args.ref_ids else None
    # one plan for all files; the driver gets a document at a time, as large as a report is
    found = documents.documents(lines, k=args.max_examples, cases=None if args.document else args.max_cases).orderBy("doc_id").toLocalIterator()
    first = list(islice(found, 2))
    for r in chain(first, found):
        doc = json.loads(r.document)
        if args.document:
            print(json.dumps(doc))
            continue
        if len(first) > 1:
            print(f"{r.doc_id}:")
        print(cases.written(doc, args.max_cases, ids_of(doc, refs) if refs else None))
    return 0


def ids_of(doc: dict, refs: DataFrame) -> dict[int, str]:
    """The ids of the lines that a document shows, and of no others."""
    shown: set[int] = set()

    def look(x) -> None:
        if isinstance(x, dict):
            if isinstance(x.get("ex"), list):
                shown.update(n for _, n in x["ex"])
            for y in x.values():
                look(y)

    look(doc)
    return {r.line_no: r.ref_id for r in refs.where(F.col("line_no").isin(sorted(shown))).collect()}


def write_tables(spark: SparkSession, args: argparse.Namespace) -> int:
    for name, table in tables.TABLES.items():
        text.write_mapping(spark, table(), f"{args.out}/{name}")
    text.write_json(tables.compared(spark), f"{args.out}/compared-tables")
    text.write_json(tables.compared_characters(spark), f"{args.out}/compared-characters")
    return 0


if __name__ == "__main__":
    sys.exit(main())
