"""Command line: ingest, search, emit, list, info, context, remove, rebuild-index."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import functions as F

from marlstone import config as configs
from marlstone.errors import MarlstoneError
from marlstone.functions import text as fn
from marlstone.library import Library, emitter
from marlstone.operators.embedding import ApiEmbedder, HashEmbedder
from marlstone.session import session
from marlstone.storage.store import Store


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone")
    top.add_argument("--config")
    commands = top.add_subparsers(dest="command", required=True)

    def command(name: str, *positional: str, as_json: bool = True) -> argparse.ArgumentParser:
        made = commands.add_parser(name)
        for p in positional:
            made.add_argument(p)
        if as_json:
            made.add_argument("--json", action="store_true")
        return made

    command("ingest", "source").add_argument("--normalize-bare-callouts", action="store_true")
    command("search", "query").add_argument("--limit", type=int, default=10)
    command("emit", "id", "format", as_json=False)
    command("list")
    command("info", "id")
    command("context", "query", as_json=False).add_argument("--budget", type=int, default=2048)
    command("remove", "id")
    command("rebuild-index")
    return top


def show(value) -> None:
    print(json.dumps(value, ensure_ascii=False, indent=2, default=str))


def run(args: argparse.Namespace) -> None:
    if args.command == "emit":
        emitter(args.format)  # a wrong format fails before anything is opened
    settings = configs.load(args.config)
    spark = session("marlstone", "local[*]")
    embedder = ApiEmbedder(settings.endpoint, settings.model, settings.dimension, configs.resolve_key(settings)) if settings.endpoint else HashEmbedder(settings.dimension or 256)
    library = Library(spark, Store(spark, settings.store), embedder, callouts=getattr(args, "normalize_bare_callouts", False))
    if args.command == "ingest":
        made = library.ingest(args.source)
        show({"document_id": made}) if args.json else print(made)
    elif args.command == "search":
        rows = library.query(args.query, args.limit).withColumn("snippet", fn.snippet(F.col("content"))).orderBy("rank").collect()
        if args.json:
            show([{k: r[k] for k in ("chunk_id", "document_id", "section_path", "content", "block_type", "sequence_index", "token_count", "distance")} for r in rows])
        for r in [] if args.json else rows:
            print(f"[{' > '.join(r['section_path']) or '(root)'}] {r['snippet']}")
        if not rows and not args.json:
            print("(no results)")
    elif args.command == "emit":
        print(library.emit(args.id, args.format))
    elif args.command == "list":
        count = 0
        for r in library.list().toLocalIterator():  # a partition at a time
            if args.json:
                print(("[" if not count else ",") + "\n  " + json.dumps(r.asDict(), ensure_ascii=False, default=str), end="")
            else:
                print(f"{r['document_id']}\t{r['title'] or '(untitled)'}")
            count += 1
        if args.json:
            print("\n]" if count else "[]")
        elif not count:
            print("(no documents)")
    elif args.command == "info":
        found = library.info(args.id)
        if args.json:
            show(found)
        else:
            for k, v in found.items():
                print(f"{k}: {v}")
    elif args.command == "context":
        print(library.context_window(args.query, args.budget))
    elif args.command == "remove":
        library.remove(args.id)
        show({"removed": args.id}) if args.json else print(f"removed {args.id}")
    else:
        count = library.rebuild_index()
        show({"vectors_indexed": count}) if args.json else print(f"{count} vectors indexed")


def main(argv: list[str] | None = None) -> int:
    args = arguments().parse_args(argv)
    try:
        run(args)
        return 0
    except MarlstoneError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
