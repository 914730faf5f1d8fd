"""Parsed tables that are kept and used again."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def fingerprint(spark: SparkSession, source: str) -> list[tuple[str, int, int]]:
    """Name, length and time of change of all files of a source, in order of their names."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    out = []
    for status in jvm.org.apache.hadoop.fs.Path(source).getFileSystem(conf).globStatus(jvm.org.apache.hadoop.fs.Path(source)) or []:
        fs, waiting = status.getPath().getFileSystem(conf), [status]
        while waiting:
            x = waiting.pop()
            if x.isDirectory():
                waiting += list(fs.listStatus(x.getPath()))
            else:
                out.append((x.getPath().toString(), x.getLen(), x.getModificationTime()))
    return sorted(out)


def cached(spark: SparkSession, source: str, root: str, name: str, options: dict, load: Callable[[], DataFrame], renew: bool = False) -> DataFrame:
    """What ``load`` makes of ``source``, kept as a table under ``root``.

    The table's name has a hash of the source's files and of the options, so a changed file or
    option is loaded anew.  It is written beside its place and moved there when complete; if
    another run was first, its table is used.  ``renew`` loads anew whatever is there."""
    files = fingerprint(spark, source)
    if not files:
        raise FileNotFoundError(source)
    key = hashlib.sha256(json.dumps([name, files, options], sort_keys=True, default=str).encode()).hexdigest()[:32]
    path = spark._jvm.org.apache.hadoop.fs.Path
    target, made = f"{root.rstrip('/')}/{name}-{key}", f"{root.rstrip('/')}/.{name}-{key}-{uuid.uuid4().hex}"
    fs = path(target).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    done = lambda: fs.exists(path(f"{target}/_SUCCESS"))
    if renew or not done():
        load().write.parquet(made)
        if renew or (fs.exists(path(target)) and not done()):
            fs.delete(path(target), True)
        if not fs.rename(path(made), path(target)) and not done():
            raise OSError(f"{made} could not be moved to {target}")
        if fs.exists(path(made)):
            fs.delete(path(made), True)
    return spark.read.parquet(target)
