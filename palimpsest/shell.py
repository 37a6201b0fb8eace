"""Command line: one-shot or interactive.

    python -m palimpsest.shell ROOT get KEY | put KEY VALUE | del KEY | scan [START [END [N]]]
        | status | split KEY | ranges | txn STATEMENT ; ... | sql STATEMENT | help

Statements of `txn` are get K, set K V, del K, scan [START [END]], separated by ';'.
Without a command it reads commands from standard input.
"""

from __future__ import annotations

import sys

from pyspark.sql import SparkSession

from palimpsest.engine import Engine, Txn, format_result
from palimpsest.errors import EngineError, InvalidArgument

HELP = __doc__.split("\n\n", 1)[1]


def _pairs(rows) -> list[str]:
    return [f"{bytes(r.key).decode(errors='replace')} = {bytes(r.value).decode(errors='replace')}" for r in rows.collect()]


def run_txn(txn: Txn, text: str) -> list[str]:
    """Run statements in a transaction and commit it; any failure rolls it back."""
    out = []
    try:
        for words in (s.split() for s in text.split(";")):
            match words:
                case []:
                    continue
                case ["get", key]:
                    out.append(txn.get(key.encode()).decode(errors="replace"))
                case ["set", key, *value] if value:
                    txn.put(key.encode(), " ".join(value).encode())
                case ["del", key]:
                    txn.delete(key.encode())
                case ["scan", *bounds] if len(bounds) <= 2:
                    out += _pairs(txn.scan(*(b.encode() for b in bounds)))
                case _:
                    raise InvalidArgument(f"unknown statement {' '.join(words)}")
        ts = txn.commit()
    except EngineError:
        txn.rollback()
        raise
    return [*out, "committed" if ts is None else f"committed at {ts}"]


def run_command(engine: Engine, line: str) -> list[str]:
    """The lines that a command prints."""
    word, _, rest = line.strip().partition(" ")
    args = rest.split()
    match word, args:
        case "get", [key]:
            return [engine.get(key.encode()).decode(errors="replace")]
        case "put", [key, _, *_]:
            engine.put(key.encode(), rest.strip()[len(key) :].strip().encode())
            return ["OK"]
        case "del", [key]:
            engine.delete(key.encode())
            return ["OK"]
        case "scan", _ if len(args) <= 3:
            start, end, n = [*args, "", "", "0"][:3] if len(args) < 3 else args
            return _pairs(engine.scan(start.encode(), end.encode(), int(n) if n.isdigit() else 0))
        case "status", []:
            return [f"{r.field}: {r.value}" for r in engine.status().collect()]
        case "split", [key]:
            engine.split(key.encode())
            return ["OK"]
        case "ranges", []:
            from palimpsest.operators.ranges import described

            return [f"{r.id} {r.bounds}" for r in described(engine.ranges()).collect()]
        case "txn", _ if args:
            return run_txn(engine.begin(), rest)
        case "sql", _ if args:
            return format_result(engine.execute(rest)).split("\n")
        case "help", _:
            return HELP.split("\n")
    raise InvalidArgument(f"unknown command {line.strip()}")


def main(args: list[str]) -> int:
    if not args:
        print(__doc__)
        return 2
    engine = Engine(SparkSession.builder.appName("palimpsest").getOrCreate(), args[0])
    lines, failed = [" ".join(args[1:])] if len(args) > 1 else sys.stdin, 0
    for line in lines:
        if line.strip():
            try:
                print("\n".join(run_command(engine, line)))
            except EngineError as e:
                print(f"error: {e}")
                failed = 1
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
