"""A small shell: python -m brindle [--db PATH] [--init FILE] [SQL ...]; without SQL it reads statements from the terminal.

Dot commands: .import [--ascii|--csv|--tsv] [--skip-header] [--escape C] FILE TABLE, .read FILE, .quit.
"""

from __future__ import annotations

import argparse
import atexit
import shlex
import sys
from pathlib import Path

from brindle.errors import SqlError
from brindle.functions.scalar import AGGREGATES, SCALARS
from brindle.plans.lexer import KEYWORDS
from brindle.session import Database, Session


def shown(value) -> str:
    """NULL, t and f, blobs as hexadecimal, reals without an exponent's noise."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "t" if value else "f"
    if isinstance(value, bytes | bytearray):
        return "\\x" + bytes(value).hex()
    return str(value)


def print_rows(df, out=None) -> None:
    """A table of a result that a person is to read; rows are fetched partition by partition."""
    rows = [[shown(v) for v in r] for r in df.toLocalIterator()]
    head = df.columns
    if not head:
        return
    wide = [max(len(x) for x in col) for col in zip(head, *rows)]
    for r in [head, ["-" * w for w in wide], *rows]:
        print(" | ".join(x.ljust(w) for x, w in zip(r, wide)).rstrip(), file=out or sys.stdout)


def command(session: Session, line: str) -> bool:
    """Run a line; False to stop."""
    words = shlex.split(line) if line.startswith(".") else []
    if words[:1] in ([".quit"], [".exit"]):
        return False
    if words[:1] == [".read"]:
        with open(words[1]) as f:
            session.script(f.read())
    elif words[:1] == [".import"]:
        p = argparse.ArgumentParser(".import", exit_on_error=False)
        for form in ("ascii", "csv", "tsv"):
            p.add_argument(f"--{form}", dest="form", action="store_const", const=form, default="csv")
        p.add_argument("--skip-header", action="store_true")
        p.add_argument("--escape")
        p.add_argument("file")
        p.add_argument("table")
        a = p.parse_args(words[1:])
        print(session.load_file(a.table, a.file, a.form, a.skip_header, a.escape))
    elif words:
        raise SqlError(f"unknown command {words[0]}")
    elif line.strip():
        print_rows(session.query(line))
    return True


def completions(session: Session, text: str) -> list[str]:
    """Dot commands, keywords (in the case that was typed), tables, views and functions that begin so."""
    words = {k.upper() if text.isupper() else k for k in KEYWORDS}
    words |= {".import", ".read", ".quit", *session.state["tables"], *session.state["views"], *session.db.external, *SCALARS, *AGGREGATES}
    return sorted(w for w in words if w.startswith(text))


def edited_lines(session: Session, history: Path) -> None:
    """History and completion of the lines read, where the platform has readline."""
    try:
        import readline
    except ImportError:
        return
    if history.exists():
        readline.read_history_file(history)
    atexit.register(readline.write_history_file, history)
    readline.set_completer_delims(" \t\n()=<>,;+-*/%|'\"")
    readline.set_completer(lambda text, k: [*completions(session, text), None][k])
    readline.parse_and_bind("tab: complete")


def main(argv: list[str]) -> int:
    p = argparse.ArgumentParser("brindle", description=__doc__)
    p.add_argument("--db")
    p.add_argument("--init")
    p.add_argument("sql", nargs="*")
    a = p.parse_args(argv)
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("brindle").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    session = Database(spark, a.db).connect()
    if a.init:
        with open(a.init) as f:
            session.script(f.read())
    for sql in a.sql:
        command(session, sql)
    if not a.sql:
        edited_lines(session, Path.home() / ".brindle_history")
    while not a.sql:
        try:
            line = input("brindle> ")
            while not line.startswith(".") and line.strip() and not line.rstrip().endswith(";"):
                line += "\n" + input("     ...> ")
            if not command(session, line):
                break
        except EOFError:
            break
        except (SqlError, OSError) as x:
            print(f"error: {x}", file=sys.stderr)
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
