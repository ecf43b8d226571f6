"""What both jobs share: a config file read by Spark, a session for the command line, and logging."""

from __future__ import annotations

import argparse
import contextlib
import logging
from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

log = logging.getLogger("jobs")


def config(spark: SparkSession, path: str | None, known: dict) -> dict:
    """The defaults, with what a JSON file says instead; a name that the job doesn't know is an error."""
    if path is None:
        return dict(known)
    said = spark.read.json(path, multiLine=True).first().asDict(recursive=True)
    if unknown := set(said) - set(known):
        raise ValueError(f"{path}: unknown settings {', '.join(sorted(unknown))}")
    return known | said


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (_ for .) that hold inside and are as before afterwards."""
    names = {k.replace("_", "."): v for k, v in values.items()}
    had = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in had.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def has_table(spark: SparkSession, path: str) -> bool:
    """Whether Spark finds files of a table there."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def command(doc: str, names: tuple[str, ...], run: Callable[..., dict], defaults: dict) -> None:
    """A command line with these paths and --config, in a session of its own."""
    parser = argparse.ArgumentParser(description=doc)
    for name in names:
        parser.add_argument(name)
    parser.add_argument("--config", help="a JSON file; see the one beside the job")
    said = vars(parser.parse_args())
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *(said[n] for n in names), config(spark, said["config"], defaults))
    finally:
        spark.stop()
