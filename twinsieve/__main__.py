"""Command line: python -m twinsieve --scan FOLDER --index STORE, or --benchmark JOURNALS, or --query NAME --data FOLDER."""

from __future__ import annotations

import argparse
import sys

from . import session


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser("twinsieve")
    p.add_argument("--version", action="version", version="twinsieve 1.0.0")
    p.add_argument("--scan")
    p.add_argument("--index")
    p.add_argument("--mode", choices=("full", "delta"), default="full")
    p.add_argument("--benchmark")
    p.add_argument("--run")
    p.add_argument("--query")
    p.add_argument("--data")
    a = p.parse_args(args)
    spark = session.ship(session.local_session())
    if a.scan and a.index:
        from .plans.scan import MediaIndex

        print(MediaIndex(spark, a.scan, a.index).scan(a.mode))
    elif a.benchmark:
        from .sources import journal

        lines = session.checkpointed(journal.read_journals(spark, a.benchmark))
        events, anomalies = journal.replay(lines)
        journal.runs(events, anomalies).show(truncate=False)
        journal.recover(lines, a.run).select("run_id", journal.console_block().alias("summary")).show(truncate=False)
    elif a.query and a.data:
        from .plans import function_queries, journal_queries, more_queries  # noqa: F401  register their queries
        from .plans.queries import QUERIES

        QUERIES[a.query](spark, a.data).show(50, truncate=False)
    else:
        p.print_usage(sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
