"""Command line: python -m glyphflow -s CODE [-i FILE] [-o FILE] [--maps-dir DIR]."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from .engine import Engine
from .sources.maps import folder_strategy


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="glyphflow", description="Converts a text from one script to another.", allow_abbrev=False)
    p.add_argument("-s", "--system-code", help="the map")
    p.add_argument("-i", "--input", help="a file, or - for standard input", default="-")
    p.add_argument("-o", "--output", help="a file; standard output without it")
    p.add_argument("--maps-dir", help="a folder of maps")
    return p


def main(args: list[str] | None = None) -> int:
    p = parser()
    try:
        given = p.parse_args(args)
    except SystemExit as e:
        return 0 if e.code == 0 else 1
    if not given.system_code:
        p.print_usage(sys.stderr)
        return 1
    if given.maps_dir and not Path(given.maps_dir).is_dir():
        print(f"No such folder: {given.maps_dir}", file=sys.stderr)
        return 2
    engine = Engine([folder_strategy(given.maps_dir)] if given.maps_dir else [])
    text = sys.stdin.read() if given.input == "-" else Path(given.input).read_text(encoding="utf-8")
    try:
        out = engine.convert(text, given.system_code) + "\n"
        if given.output:
            Path(given.output).write_text(out, encoding="utf-8")
        else:
            sys.stdout.write(out)
    except Exception as e:
        print(e, file=sys.stderr)
        return 1
    return 0
