"""Command line: `spark-submit` or `python -m tallywright`."""

from __future__ import annotations

import argparse
from collections.abc import Sequence
from datetime import date

from tallywright.functions.clock import LOCAL_ZONE
from tallywright.plans.catalog import REPORTS, report
from tallywright.session import build_session
from tallywright.sources.landing import PREFIX
from tallywright.sources.store import ContributionStore
from tallywright.streaming.incremental import import_new_files


def parser() -> argparse.ArgumentParser:
    main = argparse.ArgumentParser(prog="tallywright")
    commands = main.add_subparsers(dest="command", required=True)

    load = commands.add_parser("import", help="load landing files into the store")
    load.add_argument("--landing", required=True, help="landing root, any path Spark reads")
    load.add_argument("--store", required=True)
    load.add_argument("--prefix", default=PREFIX)
    load.add_argument("--new-only", action="store_true", help="skip files that the store has loaded already")
    load.add_argument("--checkpoint", help="with --new-only: a stream's folder that remembers the files, in place of the store")

    backfill = commands.add_parser("backfill", help="recompute the dates of all users")
    backfill.add_argument("--store", required=True)

    shorten = commands.add_parser("compact", help="rewrite all loads as one")
    shorten.add_argument("--store", required=True)

    tidy = commands.add_parser("clean", help="remove old commits and what only they name")
    tidy.add_argument("--store", required=True)
    tidy.add_argument("--keep", type=int, default=2, help="commits to keep")

    show = commands.add_parser("report", help="write a report as Parquet, or preview it")
    show.add_argument("name", choices=sorted(REPORTS))
    show.add_argument("--store", required=True)
    show.add_argument("--as-of", type=date.fromisoformat)
    show.add_argument("--tz", default=LOCAL_ZONE)
    where = show.add_mutually_exclusive_group(required=True)
    where.add_argument("--out", help="folder for the whole report")
    where.add_argument("--preview", type=int, metavar="ROWS", help="print the first rows only")
    return main


def main(arguments: Sequence[str] | None = None) -> None:
    args = parser().parse_args(arguments)
    store = ContributionStore(build_session(), args.store)
    if args.command == "import" and args.new_only and args.checkpoint is None:
        store.load_new(args.landing, args.prefix)
    elif args.command == "import" and args.new_only:
        query = import_new_files(store, args.landing, prefix=args.prefix, checkpoint_location=args.checkpoint)
        query.awaitTermination()
    elif args.command == "import":
        store.load_landing(args.landing, args.prefix)
    elif args.command == "backfill":
        store.backfill_users()
    elif args.command == "compact":
        store.compact()
    elif args.command == "clean":
        store.remove_old_snapshots(args.keep)
    else:
        result = report(store, args.name, as_of=args.as_of, tz=args.tz)
        if args.out:
            result.write.parquet(args.out)
        else:
            result.show(args.preview, truncate=False)


if __name__ == "__main__":
    main()
