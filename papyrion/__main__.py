"""Runs a query from the command line: ``spark-submit`` or ``python -m papyrion``.

    list                            the core's queries by name
    run QUERY FOLDER [TARGET]       its rows shown, or written to TARGET as Parquet
    options [FILE] [KEY=VALUE …]    all options by key
"""

from __future__ import annotations

import sys

from papyrion import options
from papyrion.plans import catalogue


def main(args: list[str]) -> int:
    command, *rest = args or ["help"]
    if command == "list":
        print("\n".join(sorted(catalogue.QUERIES)))
    elif command == "options":
        files = [x for x in rest if "=" not in x]
        chosen = options.assigned(options.load(files[0] if files else None), [x for x in rest if "=" in x])
        print("\n".join(f"{k} = {v}" for k, v in options.keys(chosen)))
    elif command == "run" and 2 <= len(rest) <= 3 and rest[0] in catalogue.QUERIES:
        from pyspark.sql import SparkSession

        found = catalogue.QUERIES[rest[0]](SparkSession.builder.appName(rest[0]).getOrCreate(), rest[1])
        found.write.mode("errorifexists").parquet(rest[2]) if len(rest) == 3 else found.show(truncate=80)
    else:
        print(__doc__)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
