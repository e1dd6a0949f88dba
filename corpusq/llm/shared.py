"""Small helpers that several operators of this subpackage use."""

from __future__ import annotations

import re
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name under the folder that driver and executors share.

    The cluster names it in ``spark.checkpoint.dir``; only where that is unset (a local session, as in
    tests) a temporary folder takes its place.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="corpusq-")
        spark.conf.set("spark.checkpoint.dir", base)
    folder = spark._jvm.org.apache.hadoop.fs.Path(base)
    whole = folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()
    whole = re.sub("^file:/+", "file:///", whole)
    return f"{whole.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def put_in_place(fs, temp: str, final: str) -> None:
    """Rename a finished file; one that an earlier attempt of the same task has left there gives way."""
    if fs.get_file_info(final).is_file:
        fs.delete_file(final)
    fs.move(temp, final)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` stored as a Parquet table in the shared folder and read again: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def split_hot(df: DataFrame, key: list[str], member: str, most: int) -> DataFrame:
    """Deal the rows of each ``key`` with over ``most`` rows to blocks, two chunks of the key to a block.

    Adds ``block`` (long). Any two rows of one key meet in at least one block, and a block holds about
    ``2 * most`` rows at most, so no task has to hold a large group. Small groups are one block (0).
    """
    sizes = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > most)
    sizes = sizes.select(*(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), F.ceil(F.col("_n") / most).alias("_c"))
    on = None
    for i, k in enumerate(key):
        on = (F.col(k) == F.col(f"_k{i}")) if on is None else on & (F.col(k) == F.col(f"_k{i}"))
    own = F.pmod(F.xxhash64(F.col(member)), F.col("_c"))
    blocks = F.when(F.col("_c").isNull(), F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0).cast("long"), F.col("_c") - 1), lambda j: F.least(own, j) * F.col("_c") + F.greatest(own, j))
    )
    return df.join(sizes, on, "left").select(*df.columns, F.explode(blocks).alias("block"))


def whole_groups(batches, key: list[str]):
    """Regroup sorted pandas batches so that no run of equal ``key`` is cut between two of them."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = np.ones(len(batch), bool)
        for k in key:
            v = batch[k].to_numpy()
            last &= v == v[-1]
        cut = int(len(batch) - last[::-1].argmin()) if not last.all() else 0
        if rest and all(rest[-1][k].iloc[-1] == batch[k].iloc[0] for k in key) and cut == 0:
            rest.append(batch)
            continue
        yield pd.concat([*rest, batch.iloc[:cut]], ignore_index=True)
        rest = [batch.iloc[cut:]]
    if rest:
        yield pd.concat(rest, ignore_index=True)


def near_pairs(key: np.ndarray, linked):
    """Links inside runs of equal ``key``, thinned to those that join parts not joined before.

    ``linked(i, j)`` says for position arrays which pairs link. All pairs of a run are looked at, a lag at a
    time; pairs already connected are skipped, so the memory is a few arrays of the batch's length.
    Returns two position arrays: a spanning forest of the links.
    """
    n = len(key)
    label = np.arange(n)
    left, right = [], []
    at, lag = np.arange(n), 1
    while True:
        at = at[at + lag < n]
        at = at[key[at] == key[at + lag]]
        if not len(at):
            break
        i, j = at, at + lag
        apart = label[i] != label[j]
        i, j = i[apart], j[apart]
        if len(i):
            ok = linked(i, j)
            i, j = i[ok], j[ok]
        if len(i):
            left.append(i)
            right.append(j)
            while True:
                low, high = np.minimum(label[i], label[j]), np.maximum(label[i], label[j])
                if (low == high).all():
                    break
                np.minimum.at(label, high, low)
                while True:
                    down = label[label]
                    if (down == label).all():
                        break
                    label = down
        lag += 1
    empty = np.zeros(0, np.int64)
    return (np.concatenate(left), np.concatenate(right)) if left else (empty, empty)
