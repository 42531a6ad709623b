"""Command line: JSON answers on standard output; errors as JSON on standard error with exit code 2."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from .budget import Budget, compact
from .compare import ReconcileOptions, reconcile
from .errors import EngineError
from .paths import within
from .workbook import Workbook

CACHE = ".quillgrid-cache"
SPEC = {"before_ranges", "after_ranges", "schema", "keys", "compare_columns"}


class Inside(str):
    """A path that must lie in the workspace."""


def parser() -> argparse.ArgumentParser:
    # Command, argument and option names and their defaults are the interface: fixed values.
    p = argparse.ArgumentParser(prog="quillgrid", description="Bounded questions to workbooks.")
    p.add_argument("--workspace", default=".")
    p.add_argument("--cache-dir", type=Inside)
    p.add_argument("--max-chars", type=int, default=12000)
    p.add_argument("--max-cells", type=int, default=2000)
    p.add_argument("--max-rows", type=int, default=100)
    p.add_argument("--metrics", action="store_true", help="counters and timers on standard error")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, answer, *positional: str, file: bool = True):
        c = sub.add_parser(name)
        c.set_defaults(answer=answer)
        if file:
            c.add_argument("file", type=Inside)
        for x in positional:
            c.add_argument(x)
        return c

    def paged(c):
        c.add_argument("--offset", type=int, default=0)
        c.add_argument("--limit", type=int, default=20)
        return c

    def flags(c, *names: str):
        for name in names:
            c.add_argument(name, action="store_true")
        return c

    c = flags(paged(command("inspect", _inspect)), "--deep")
    c.add_argument("--sheet")
    c.add_argument("--section", default="summary")
    c = flags(command("find", lambda book, a: book.find_text(a.query, a.sheet, a.limit, a.full), "query"), "--full")
    c.add_argument("--sheet", action="append")
    c.add_argument("--limit", type=int, default=20)
    of_range = {"read": Workbook.read_range, "formulas": Workbook.get_formulas, "dependencies": Workbook.get_dependencies, "styles": Workbook.get_styles, "validate": Workbook.validate_range}
    for name, method in of_range.items():
        command(name, lambda book, a, method=method: method(book, a.sheet, a.range), "sheet", "range")
    paged(command("patterns", lambda book, a: book.formula_patterns(a.sheet, a.limit, a.offset), "sheet"))
    for name, answer in (("query", _query), ("query-sheets", _query_sheets)):
        c = flags(command(name, answer, "sql"), "--cached-formulas", "--no-persistent-cache")
        c.add_argument("--schema", type=Inside, required=True)
    c.add_argument("--ranges", type=Inside, required=True)
    c.add_argument("--name", default="Sales")
    c.add_argument("--source-column", default="_sheet")
    c = flags(command("patch", lambda book, a: book.patch_cells(_json(a.patch_file), a.output, a.overwrite)), "--overwrite")
    c.add_argument("patch_file", type=Inside)
    c.add_argument("output", type=Inside)
    c = flags(command("reconcile", None, file=False), "--overwrite", "--cached-formulas", "--no-persistent-cache")
    c.add_argument("before", type=Inside)
    c.add_argument("after", type=Inside)
    c.add_argument("--spec", type=Inside, required=True)
    c.add_argument("--output", type=Inside)
    c.add_argument("--sample-limit", type=int, default=20)
    return p


def _json(path: Path):
    try:
        return json.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError) as e:
        raise EngineError(f"cannot read {path}: {e}") from e


def run(args: argparse.Namespace) -> tuple[object, dict]:
    budget = Budget(args.max_cells, args.max_rows, args.max_chars)
    for name, value in list(vars(args).items()):
        if isinstance(value, Inside):
            setattr(args, name, within(value, args.workspace))
    cache = str(args.cache_dir or within(CACHE, args.workspace))
    if args.answer is None:
        return _reconcile(args, budget, cache), {}
    with Workbook(args.file, cache_dir=cache, budget=budget) as book:
        return args.answer(book, args), book.metrics.report()


def _reconcile(args: argparse.Namespace, budget: Budget, cache: str):
    spec = _json(args.spec)
    if not isinstance(spec, dict) or not set(spec) <= SPEC:
        raise EngineError("a specification has only " + ", ".join(sorted(SPEC)))
    options = ReconcileOptions(budget, cache, args.sample_limit, args.output, args.overwrite, args.cached_formulas, not args.no_persistent_cache)
    try:
        return reconcile(args.before, args.after, **spec, options=options)
    except TypeError as e:
        raise EngineError(f"incomplete specification: {e}") from None


def _inspect(book: Workbook, args: argparse.Namespace):
    if args.sheet:
        return book.inspect_sheet(args.sheet, args.deep, args.section, args.offset, args.limit)
    return book.inspect_workbook(args.offset, args.limit)


def _query(book: Workbook, args: argparse.Namespace):
    schemas = _json(args.schema)
    if not isinstance(schemas, dict):
        raise EngineError("the schema file names tables and their columns")
    for name, schema in schemas.items():
        book.load(name, schema=schema, columns=list(schema), allow_cached_formulas=args.cached_formulas, persistent_cache=not args.no_persistent_cache)
    return book.query(args.sql)


def _query_sheets(book: Workbook, args: argparse.Namespace):
    book.load_sheets(args.name, _json(args.ranges), _json(args.schema), args.source_column, args.cached_formulas, not args.no_persistent_cache)
    return book.query(args.sql)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    try:
        told, metrics = run(args)
        print(compact(told, Budget(args.max_cells, args.max_rows, args.max_chars)))
        if args.metrics:
            print(json.dumps(metrics), file=sys.stderr)
        return 0
    except EngineError as e:
        print(json.dumps({"error": type(e).__name__, "message": str(e)}), file=sys.stderr)
        return 2
    except OSError as e:
        print(json.dumps({"error": "OSError", "message": str(e)}), file=sys.stderr)
        return 2
