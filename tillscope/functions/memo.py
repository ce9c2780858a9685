"""Results kept by what they were made from.

The key of a result is a digest of its name, its parameters, the plan of the
input and the files that the plan reads, with their sizes and times. A result
is written to a folder of its own and published by renaming that folder, so a
reader sees a whole result or none; a second writer of the same key finds it
published and drops its own copy.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tillscope.functions.staging import shared_root


def _files(df: DataFrame) -> list[tuple[str, int, int]]:
    """(path, size, time) of the files that a plan reads, one listing a folder."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wanted = set(df.inputFiles())
    found = []
    for folder in sorted({f.rpartition("/")[0] for f in wanted}):
        path = jvm.org.apache.hadoop.fs.Path(folder)
        for s in path.getFileSystem(conf).listStatus(path):
            found.append((s.getPath().toUri().toString(), s.getLen(), s.getModificationTime()))
    plain = {f.replace(":///", ":/") for f in wanted}
    return sorted(x for x in found if x[0].replace(":///", ":/") in plain)


def key_of(df: DataFrame, name: str, params: dict) -> str:
    """Digest of a result's name, parameters, input plan and input files."""
    analysed = df._jdf.queryExecution().analyzed().canonicalized()
    told = [name, json.dumps(params, sort_keys=True, default=str), analysed.toString(), df.semanticHash(), df.schema.json(), _files(df)]
    return hashlib.sha256(json.dumps(told).encode()).hexdigest()


def memoised(df: DataFrame, name: str, build: Callable[..., DataFrame], **params) -> DataFrame:
    """``build(df, **params)``, from the shared folder if it was made there from the same plan, files and parameters."""
    spark: SparkSession = df.sparkSession
    root = f"{shared_root(spark)}/memo"
    target = f"{root}/{name}-{key_of(df, name, params)}"
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    store = path.getFileSystem(conf)
    if not store.exists(path):
        own = f"{root}/.{name}-{uuid.uuid4().hex}"
        build(df, **params).write.parquet(own)
        made = jvm.org.apache.hadoop.fs.Path(own)
        try:
            published = not store.exists(path) and store.rename(made, path)
        except Exception:  # another writer was first
            published = False
        if not published:
            store.delete(made, True)
    return spark.read.parquet(target)
