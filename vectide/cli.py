"""Command line: ``python -m vectide.cli <command> ...``."""

from __future__ import annotations

import argparse
import sys

from vectide.errors import VectideError
from vectide.schema import FLOAT32, SCALAR8, EXACT, GraphParams, IndexKind, encoding_label, graph_index

INDEXES = {"exact": EXACT, "graph": graph_index(), "hnsw": graph_index()}
ENCODINGS = {"f32": FLOAT32, "float32": FLOAT32, "int8": SCALAR8, "scalar": SCALAR8}


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        raise ValueError(message)


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="vectide", description="Vector collections on Spark. Vectors are numbers separated by commas or white space; @path reads them from a file.")
    sub = top.add_subparsers(dest="command", parser_class=_Parser)

    def add(name, text):
        return sub.add_parser(name, help=text)

    c = add("create", "make an empty collection, in place of any at this path")
    c.add_argument("path")
    c.add_argument("--dim", type=int, required=True)
    c.add_argument("--index", choices=sorted(INDEXES), default="exact")
    c.add_argument("--encoding", choices=sorted(ENCODINGS), default="f32")
    i = add("insert", "add a record, or replace it with --upsert")
    i.add_argument("path")
    i.add_argument("--id", type=int, required=True)
    i.add_argument("--vector", required=True)
    i.add_argument("--text", default="")
    i.add_argument("--meta", action="append", default=[], metavar="K=V")
    i.add_argument("--upsert", action="store_true")
    d = add("delete", "remove a record and compact")
    d.add_argument("path")
    d.add_argument("--id", type=int, required=True)
    s = add("search", "print the nearest records")
    s.add_argument("path")
    s.add_argument("--vector", required=True)
    s.add_argument("-k", "--limit", type=int, default=10)
    s.add_argument("--filter", action="append", default=[], metavar="K=V")
    s.add_argument("--lazy", "--mmap", action="store_true", help="scan in place, without loading")
    for name, text in (("stats", "describe a collection"), ("compact", "rebuild and save")):
        add(name, text).add_argument("path")
    e = add("export", "write a JSON copy")
    e.add_argument("path")
    e.add_argument("json")
    m = add("import", "make a collection from JSON")
    m.add_argument("json")
    m.add_argument("path")
    add("help", "show this message")
    return top


def pairs(items: list[str]) -> dict[str, str]:
    out = {}
    for item in items:
        key, eq, value = item.partition("=")
        if not eq:
            raise ValueError(f"expected key=value, got '{item}'")
        out[key] = value
    return out


def _vector(text: str) -> list[float]:
    from vectide.functions.text import parse_vector

    if text.startswith("@"):
        with open(text[1:], encoding="utf-8") as f:
            text = f.read()
    return parse_vector(text)


def run(args: argparse.Namespace, spark, say=print) -> None:
    from vectide.collection import Collection, LazyCollection
    from vectide.sources import files

    cmd = args.command
    if cmd == "create":
        index: IndexKind = INDEXES[args.index]
        encoding = ENCODINGS[args.encoding]
        Collection.create(spark, args.dim, index, encoding).save(args.path)
        say(f"Created {args.path}: dim={args.dim}, index={index.label()}, encoding={encoding_label(encoding)}")
    elif cmd == "insert":
        c = Collection.load(spark, args.path)
        row = {"id": args.id, "vector": _vector(args.vector), "text": args.text, "metadata": pairs(args.meta)}
        (c.upsert if args.upsert else c.insert)([row])
        c.save(args.path)
        say(f"{'Upserted' if args.upsert else 'Inserted'} record {args.id} ({c.count()} total)")
    elif cmd == "delete":
        c = Collection.load(spark, args.path)
        c.delete(args.id)
        c.compact()
        c.save(args.path)
        say(f"Deleted record {args.id} ({c.count()} left)")
    elif cmd == "search":
        c = LazyCollection(spark, args.path) if args.lazy else Collection.load(spark, args.path)
        hits = c.search(_vector(args.vector), args.limit, pairs(args.filter)).collect()
        for r in hits:
            say(f"{r['rank']:>2}. [{r['score']:.4f}] id={r['id']} {r['text']}")
        if not hits:
            say("no results")
    elif cmd == "stats":
        c = Collection.load(spark, args.path)
        for name, value in {"path": args.path, **c.stats(), "bytes": files.size(spark, args.path)}.items():
            say(f"{name + ':':<11}{'unset' if value is None else value}")
    elif cmd == "compact":
        c = Collection.load(spark, args.path)
        n = c.compact()
        c.save(args.path)
        say(f"Compacted {args.path} ({n} reclaimed)")
    elif cmd == "export":
        Collection.load(spark, args.path).export_json(args.json)
        say(f"Exported {args.path} to {args.json}")
    elif cmd == "import":
        c = Collection.import_json(spark, args.json)
        c.save(args.path)
        say(f"Imported {args.json} to {args.path} ({c.count()} records)")


def demo(spark, say=print) -> None:
    """Three records and one search."""
    from vectide.collection import Collection

    c = Collection.create(spark, 3)
    c.insert([
        {"id": 1, "vector": [0.9, 0.1, 0.0], "text": "cats", "metadata": {"topic": "animals"}},
        {"id": 2, "vector": [0.8, 0.2, 0.1], "text": "dogs", "metadata": {"topic": "animals"}},
        {"id": 3, "vector": [0.1, 0.1, 0.9], "text": "compilers", "metadata": {"topic": "software"}},
    ])
    for r in c.search([0.85, 0.15, 0.05], 3).collect():
        say(f"[{r['score']:.3f}] {r['id']} {r['text']}")


def main(argv: list[str] | None = None, spark=None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    top = parser()
    if not argv or argv[0] in ("help", "--help", "-h"):
        top.print_help()
        return 0
    try:
        args = top.parse_args(argv)
        if spark is None:
            from pyspark.sql import SparkSession

            spark = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
        run(args, spark)
    except (VectideError, ValueError, OSError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


__all__ = ["GraphParams", "demo", "main", "run"]

if __name__ == "__main__":
    sys.exit(main())
