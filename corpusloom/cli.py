"""Command line: pack, keygen, verify, info, export, search, convert, serve, find."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .plans.convert import convert_folder
from .plans.report import write_tree
from .plans.search import Corpus
from .plans.server import serve
from .session import session
from .sources import store


def safe_print(text: str, out=None) -> None:
    """Characters that the console can't show are replaced, never raised."""
    out = out or sys.stdout
    encoding = getattr(out, "encoding", None) or "utf-8"
    print(text.encode(encoding, "replace").decode(encoding), file=out)


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="corpusloom", description=__doc__)
    sub = top.add_subparsers(dest="command", required=True)
    p = sub.add_parser("pack")
    p.add_argument("folder")
    p.add_argument("--target", required=True)
    p.add_argument("--key", required=True)
    p.add_argument("--issuer", default="")
    p.add_argument("--signing-key", help="private and public key, joined by a comma")
    sub.add_parser("keygen")
    p = sub.add_parser("verify")
    p.add_argument("path")
    p.add_argument("--public-key")
    sub.add_parser("info").add_argument("path")
    p = sub.add_parser("export")
    p.add_argument("path")
    p.add_argument("--target", required=True)
    p.add_argument("--key", required=True)
    p = sub.add_parser("search")
    p.add_argument("path")
    p.add_argument("query")
    p.add_argument("--key", required=True)
    p.add_argument("--limit", type=int, default=5)
    p.add_argument("--only", choices=("received", "sent"))
    p.add_argument("--mode", choices=("auto", "lexical", "semantic"), default="auto")
    p = sub.add_parser("convert")
    p.add_argument("--input", required=True)
    p.add_argument("--output", required=True)
    p.add_argument("--only", default="*")
    p.add_argument("--limit", type=int, help="the first files by path")
    p = sub.add_parser("serve")
    p.add_argument("folders", nargs="+", help="folders of Markdown documents, each a package")
    p = sub.add_parser("find")
    p.add_argument("phrases", nargs="+")
    p.add_argument("--output", required=True)
    p.add_argument("--context", type=int, default=1)
    p.add_argument("--only", choices=("received", "sent"))
    p.add_argument("--limit", type=int, default=12)
    p.add_argument("--literal", action="store_true")
    p.add_argument("--bm25", action="store_true")
    return top


def main(argv: list[str] | None = None) -> int:
    args = _parser().parse_args(argv)
    if args.command == "info":
        safe_print(json.dumps(store.read_header(Path(args.path).read_bytes()), indent=2))
        return 0
    spark = session()
    if args.command == "keygen":
        safe_print("\n".join(store.generate_signing_key(spark)))
    elif args.command == "verify":
        return 0 if store.verify_signature(spark, Path(args.path).read_bytes(), args.public_key) else 1
    elif args.command == "pack":
        signing = tuple(args.signing_key.split(",")) if args.signing_key else None
        Path(args.target).write_bytes(store.pack(store.load_documents(spark, args.folder), args.key, args.issuer, signing=signing))
    elif args.command == "export":
        _, package = store.open_bundle(spark, Path(args.path).read_bytes(), args.key)
        for row in store.export(package).toLocalIterator():
            file = Path(args.target, row["path"])
            if not file.resolve().is_relative_to(Path(args.target).resolve()):
                raise ValueError("the bundle holds a path outside the target folder")
            file.parent.mkdir(parents=True, exist_ok=True)
            file.write_text(row["text"], encoding="utf-8")
    elif args.command == "search":
        header, package = store.open_bundle(spark, Path(args.path).read_bytes(), args.key)
        corpus = Corpus(package["document"], package["passage"], language=header["language"])
        for row in corpus.query(args.query, args.limit, args.only, args.mode).collect():
            safe_print(f"{row['name']} ({row['source']}): {row['text']}")
    elif args.command == "serve":
        serve({Path(f).name: Corpus(store.load_documents(spark, f)) for f in args.folders}, sys.stdin, sys.stdout)
    elif args.command == "convert":
        table = f"{args.output.rstrip('/')}/_records"
        convert_folder(spark, args.input, args.only, limit=args.limit).write.mode("overwrite").parquet(table)
        records = spark.read.parquet(table)
        safe_print(json.dumps(write_tree(records, args.output), indent=2, default=str))
        return 0 if records.filter("NOT ok").isEmpty() else 1
    else:
        corpus = Corpus(store.load_documents(spark, args.output))
        for phrase in args.phrases:
            if args.literal:
                hits = corpus.search_literal(phrase, args.only, args.limit)
            elif args.bm25:
                hits = corpus.rank_passages(phrase, args.context, args.only, args.limit)
            else:
                hits = corpus.search(phrase, args.only, args.limit, args.context)
            safe_print(json.dumps({phrase: [r.asDict() for r in hits.collect()]}, ensure_ascii=False, indent=2))
    return 0


if __name__ == "__main__":
    sys.exit(main())
