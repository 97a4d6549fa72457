"""Command line: count, head, tail, select, filter, sort, stats, validate, convert, benchmark, completions."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

PREFIX = "LOOMFRAME"
CONFIG_NAMES = (".loomframerc", ".loomframerc.json", "loomframe.config.json")
COMMANDS = ("count", "head", "tail", "select", "filter", "sort", "stats", "validate", "convert", "benchmark", "completions")
#: Flag, reader option, kind of value.
FLAGS = (
    ("--quote-char", "quote_char", str), ("--escape-char", "escape_char", str), ("--trim", "trim", bool), ("--ltrim", "ltrim", bool), ("--rtrim", "rtrim", bool), ("--skip-errors", "skip_records_with_error", bool),
    ("--skip-empty-values", "skip_records_with_empty_values", bool), ("--skip-empty", "skip_empty_rows", str), ("--max-record-size", "max_record_size", int), ("--relax-columns", "relax_column_count", bool),
    ("--relax-columns-less", "relax_column_count_less", bool), ("--relax-columns-more", "relax_column_count_more", bool), ("--from-line", "from_line", int), ("--to-line", "to_line", int), ("--preview", "preview", int),
    ("--skip-lines", "skip_first_n_lines", int), ("--fast", "fast_mode", bool), ("--duplicate-headers", "duplicate_headers", str), ("--comments", "comments", bool), ("--dynamic-typing", "dynamic_typing", bool), ("--delimiters-to-guess", "delimiters_to_guess", str),
)


def parser() -> argparse.ArgumentParser:
    common = argparse.ArgumentParser(add_help=False)
    common.add_argument("-d", "--delimiter")
    common.add_argument("-e", "--encoding")
    common.add_argument("--no-header", action="store_true", default=None)
    common.add_argument("--format", choices=("auto", "table", "csv", "json", "jsonl"))
    common.add_argument("--color", action="store_true", default=None)
    common.add_argument("--no-color", action="store_true", default=None)
    for flag, option, kind in FLAGS:
        common.add_argument(flag, dest=option, **({"action": "store_true", "default": None} if kind is bool else {"type": kind}))
    top = argparse.ArgumentParser(prog="loomframe", description="Delimited text on Spark.")
    subs = top.add_subparsers(dest="command", required=True)
    for name in COMMANDS:
        sub = subs.add_parser(name, parents=[common])
        if name == "completions":
            sub.add_argument("shell", choices=("bash", "zsh", "fish"))
            continue
        if name in ("filter",):
            sub.add_argument("expression")
        if name == "select":
            sub.add_argument("columns")
        sub.add_argument("file", help="a path, a URL, or - for standard input")
        if name in ("head", "tail"):
            sub.add_argument("-n", type=int, default=10)
        if name == "sort":
            sub.add_argument("-c", "--column", required=True)
            sub.add_argument("--desc", action="store_true")
        if name == "convert":
            sub.add_argument("-t", "--to", default="json")
            sub.add_argument("-o", "--output")
        if name == "benchmark":
            sub.add_argument("-n", "--runs", type=int, default=3)
    return top


def load_config(start: str | None = None, environ: dict[str, str] | None = None) -> dict[str, Any]:
    """Settings of the nearest config file (this folder, its parents, home), overridden by the environment."""
    environ = os.environ if environ is None else environ
    here, found = Path(start or os.getcwd()).resolve(), {}
    for folder in (here, *here.parents, Path.home()):
        path = next((folder / n for n in CONFIG_NAMES if (folder / n).is_file()), None)
        if path:
            found = json.loads(path.read_text())
            break
    for key in ("delimiter", "encoding", "format"):
        if value := environ.get(f"{PREFIX}_{key.upper()}"):
            found[key] = value
    if environ.get(f"{PREFIX}_NO_HEADER"):
        found["no_header"] = True
    if environ.get("NO_COLOR") or environ.get(f"{PREFIX}_NO_COLOR"):
        found["color"] = False
    return found


def show_table(rows: list[dict[str, Any]], columns: list[str]) -> str:
    if not rows:
        return "(empty)"
    text = [["" if r[c] is None else str(r[c]) for c in columns] for r in rows]
    width = [max(len(c), *(len(r[k]) for r in text)) for k, c in enumerate(columns)]
    line = lambda cells: " | ".join(x.ljust(w) for x, w in zip(cells, width, strict=True))
    return "\n".join([line(columns), "-+-".join("-" * w for w in width), *map(line, text)])


def render(table: Any, kind: str) -> str:
    from loomframe.sources.sinks import convert

    if kind == "auto":
        kind = "table" if sys.stdout.isatty() else "csv"
    return show_table(list(table.rows()), table.columns) if kind == "table" else convert(table, kind)


def _options() -> dict[str, list[tuple[list[str], list[str]]]]:
    """Of each command: the flags of an option and the values it takes, if these are fixed."""
    subs = next(x for x in parser()._actions if isinstance(x, argparse._SubParsersAction))
    return {name: [(x.option_strings or [""], [*map(str, x.choices or ())]) for x in sub._actions] for name, sub in subs.choices.items()}


def _completions(shell: str) -> str:
    options = _options()
    words = {name: " ".join([f for flags, _ in rows for f in flags if f] + [c for flags, choices in rows if flags == [""] for c in choices]) for name, rows in options.items()}
    values = {f: " ".join(choices) for rows in options.values() for flags, choices in rows for f in flags if f and choices}
    if shell == "bash":
        cases = "\n".join([f'    {n}) words="{w}" ;;' for n, w in words.items()])
        after = "\n".join([f'    {f}) COMPREPLY=($(compgen -W "{v}" -- "$here")); return ;;' for f, v in values.items()])
        return f'''_loomframe() {{
  local here="${{COMP_WORDS[COMP_CWORD]}}" words
  case "${{COMP_WORDS[COMP_CWORD-1]}}" in
{after}
  esac
  case "${{COMP_WORDS[1]}}" in
{cases}
    *) words="{" ".join(COMMANDS)}" ;;
  esac
  COMPREPLY=($(compgen -W "$words" -- "$here"))
}}
complete -o default -F _loomframe loomframe'''
    if shell == "zsh":
        cases = "\n".join([f"    {n}) compadd -- {w}; _files ;;" for n, w in words.items()])
        return f'''#compdef loomframe
_loomframe() {{
  if (( CURRENT == 2 )); then compadd -- {" ".join(COMMANDS)}; return; fi
  case "$words[2]" in
{cases}
  esac
}}
_loomframe "$@"'''
    out = [f"complete -c loomframe -n __fish_use_subcommand -a {c}" for c in COMMANDS]
    for name, rows in options.items():
        for flags, choices in rows:
            spelled = " ".join(f"-l {f[2:]}" if f.startswith("--") else f"-s {f[1:]}" for f in flags if f)
            if spelled or choices:
                out.append(f"complete -c loomframe -n '__fish_seen_subcommand_from {name}' {spelled}" + (f" -a '{' '.join(choices)}'" if choices else ""))
    return "\n".join(out)


def summary(seconds: float, n_bytes: int, rows: int | None = None) -> str:
    """Rows, seconds, rows and MB a second."""
    seconds = max(seconds, 1e-9)
    parts = [f"{n_bytes / 1e6 / seconds:.1f} MB/s"] + ([f"{rows / seconds:,.0f} rows/s"] if rows is not None else [])
    return f"{f'{rows:,} rows in ' if rows is not None else ''}{seconds:.2f} s ({', '.join(parts)})"


def _read(spark: Any, a: argparse.Namespace, config: dict[str, Any]) -> Any:
    from loomframe.sources.reader import read_csv

    options = {option: getattr(a, option) for _, option, _ in FLAGS if getattr(a, option) is not None}
    if "delimiters_to_guess" in options:
        options["delimiters_to_guess"] = options["delimiters_to_guess"].split(",")
    options["delimiter"] = a.delimiter or config.get("delimiter") or "auto"
    if encoding := a.encoding or config.get("encoding"):
        options["encoding"] = encoding
    options["has_header"] = not (a.no_header or config.get("no_header"))
    return read_csv(spark, sys.stdin.buffer if a.file == "-" else a.file, **options)


def run(argv: list[str], spark: Any = None) -> int:
    """Run one command; results go to standard output, summaries to standard error."""
    a = parser().parse_args(argv)
    if a.command == "completions":
        print(_completions(a.shell))
        return 0
    if spark is None:
        from loomframe.session import session

        spark = session("loomframe-cli", **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    from loomframe.operators.profile import profile, validate
    from loomframe.operators.table import Table
    from loomframe.sources.sinks import convert

    config = load_config()
    kind = a.format or config.get("format") or "auto"
    began = time.time()
    table = _read(spark, a, config)
    size = sum(n for _, n, _ in table.meta["files"])
    n_rows = None
    if a.command == "count":
        n_rows = table.count()
        print(n_rows)
    elif a.command in ("head", "tail"):
        print(render(table.first(a.n) if a.command == "head" else table.last(a.n), kind))
    elif a.command == "select":
        names = [c.strip() for c in a.columns.split(",")]
        print(render(table.select(*[int(c) if c.isdigit() and c not in table.columns else c for c in names]), kind))
    elif a.command == "filter":
        found = table.filter(a.expression)
        print(render(found, kind))
        n_rows = table.count()
        print(f"{found.count()} of {n_rows} rows matched", file=sys.stderr)
    elif a.command == "sort":
        print(render(table.sort(a.column, descending=a.desc), kind))
    elif a.command == "stats":
        print(render(Table(profile(table)), kind))
    elif a.command == "validate":
        report = validate(table)
        print(json.dumps(report, indent=2, ensure_ascii=False) if kind == "json" else "\n".join([f"rows: {report['rows']}", f"columns: {report['columns']} ({', '.join(report['headers'])})", *[f"row {e['row']}: {e['code']}: {e['message']}" for e in report["errors"]], "valid" if report["valid"] else f"{report['n_errors']} problems"]))
        print(summary(time.time() - began, size, report["rows"]), file=sys.stderr)
        return 0 if report["valid"] else 1
    elif a.command == "convert":
        text = convert(table, a.to)
        if a.output:
            Path(a.output).write_text(text, encoding="utf-8")
            print(f"written to {a.output}", file=sys.stderr)
        else:
            print(text)
    elif a.command == "benchmark":
        seconds = []
        for _ in range(a.runs + 1):  # the first run warms up
            t = time.time()
            table.to_df().agg(*[F.max(F.length(F.col(f"`{c}`").cast("string"))) for c in table.columns]).collect()
            seconds.append(time.time() - t)
        best = min(seconds[1:])
        print(json.dumps({"runs": a.runs, "avg_s": round(sum(seconds[1:]) / a.runs, 3), "best_s": round(best, 3), "worst_s": round(max(seconds[1:]), 3), "mb": round(size / 1e6, 3), "mb_per_s": round(size / 1e6 / best, 2)}))
    print(summary(time.time() - began, size, n_rows), file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
