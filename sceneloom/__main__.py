"""python -m sceneloom list [--pattern P05] [--family counting] [--json] | run NAME SF_DIR | explain NAME SF_DIR"""

from __future__ import annotations

import argparse
import json
import sys

from . import registry


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sceneloom", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    listing = commands.add_parser("list")
    listing.add_argument("--pattern")
    listing.add_argument("--family")
    listing.add_argument("--json", action="store_true")
    for name in ("run", "explain"):
        command = commands.add_parser(name)
        command.add_argument("query")
        command.add_argument("sf_dir")
    args = parser.parse_args(argv)
    if args.command == "list":
        found = registry.list_queries(args.pattern, args.family)
        if args.json:
            print(json.dumps([{"name": q.name, "pattern": q.pattern, "families": list(q.families), "oracle": q.oracle is not None} for q in found]))
        else:
            print(*(f"{q.name}\t{q.pattern}\t{','.join(q.families)}" for q in found), sep="\n")
        return 0
    builders = registry.all_queries()
    if args.query not in builders:
        print(f"no query named {args.query}", file=sys.stderr)
        return 2
    from .session import get_session

    df = builders[args.query](get_session(), args.sf_dir)
    df.explain("formatted") if args.command == "explain" else df.show(50, truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())
