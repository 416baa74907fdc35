"""What the jobs share: config files, logging and the command line around a function that takes a session."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys
from collections.abc import Callable
from dataclasses import fields

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def load_config(spark: SparkSession, path: str | None, kind: type):
    """A config of ``kind`` from a JSON object, its defaults where ``path`` is None. The file is read through Spark,
    so it may be where the data are. Unknown keys and wrong kinds of values are errors."""
    if path is None:
        return kind()
    given = json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))
    known = {f.name for f in fields(kind)}
    if not isinstance(given, dict) or (extra := sorted(set(given) - known)):
        raise ValueError(f"{path}: {'unknown keys ' + ', '.join(extra) if isinstance(given, dict) else 'not an object'}")
    return kind(**given)


def command(description: str, kind: type, paths: dict[str, str], run: Callable[..., dict], argv: list[str] | None = None) -> int:
    """Parse ``--config`` and one required path for each of ``paths``, make a session, run the job, stop the session."""
    parser = argparse.ArgumentParser(description=description)
    parser.add_argument("--config", help="JSON file; the defaults if left out")
    for name, text in paths.items():
        parser.add_argument(f"--{name}", required=True, help=text)
    args = vars(parser.parse_args(argv))
    logging.basicConfig(level=logging.INFO, stream=sys.stderr, format="%(asctime)s %(name)s %(levelname)s %(message)s")
    logging.getLogger("py4j").setLevel(logging.WARNING)

    from lumenfold.session import get_session

    spark = get_session(os.path.basename(sys.argv[0]) or "job")
    try:
        config = load_config(spark, args.pop("config"), kind)
        print(json.dumps(run(spark, *(args[n] for n in paths), config), sort_keys=True))
    finally:
        spark.stop()
    return 0
