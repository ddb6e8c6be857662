"""Scratch tables in the folder all executors share, and session helpers."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_FALLBACK: dict[str, str] = {}
ARROW_BYTES = "8m"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; one of our own only where that is unset."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _FALLBACK:
        _FALLBACK[app] = "file://" + tempfile.mkdtemp(prefix="circlet-")
    return _FALLBACK[app]


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/circlet/{label}-{uuid.uuid4().hex}"


@contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A session setting for a while; then what it was."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def materialise(df: DataFrame, label: str, options: dict[str, str] | None = None) -> DataFrame:
    """Cuts the lineage: writes df as Parquet into the shared folder and reads it back.

    Spark removes the shuffle files of this write as soon as it has ended, as nothing else reads them, and gives
    Python workers batches of ARROW_BYTES.
    """
    spark, path = df.sparkSession, scratch_path(df.sparkSession, label)
    with setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true"), setting(spark, "spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES):
        df.write.options(**(options or {})).parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._circlet_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table made by materialise that no later plan reads."""
    path = getattr(df, "_circlet_path", None)
    if path:
        remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def key_runs(batches, keys: list[str]):
    """Frames of whole groups of equal keys out of a partition that is sorted by them; a frame holds one or more groups."""
    import numpy as np
    import pandas as pd

    held = []
    for batch in batches:
        if not len(batch):
            continue
        values = [batch[k].to_numpy() for k in keys]
        new = np.zeros(len(batch), bool)
        for v in values:
            new[1:] |= v[1:] != v[:-1]
        starts = np.flatnonzero(new)
        same = bool(held) and all(held[-1][k].iloc[-1] == v[0] for k, v in zip(keys, values, strict=True))
        if held and not same:
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
            held = []
        if len(starts):
            held.append(batch.iloc[: starts[-1]])
            yield pd.concat(held, ignore_index=True) if len(held) > 1 else held[0].reset_index(drop=True)
            held = []
            batch = batch.iloc[starts[-1] :]
        held.append(batch.reset_index(drop=True))
    if held:
        yield pd.concat(held, ignore_index=True)


def group_bounds(frame, keys: list[str]):
    """Starts of the groups of equal keys in a sorted frame, and its length."""
    import numpy as np

    new = np.zeros(len(frame), bool)
    new[0] = True
    for k in keys:
        v = frame[k].to_numpy()
        new[1:] |= v[1:] != v[:-1]
    return np.append(np.flatnonzero(new), len(frame))


def groups(batches, keys: list[str]):
    """A frame for each group of equal keys out of a partition that is sorted by them."""
    for frame in key_runs(batches, keys):
        bounds = group_bounds(frame, keys)
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            yield frame.iloc[lo:hi]


def slices(batches, column: str = "text", chars: int = 1 << 20):
    """The batches in parts of about so many characters of a column, so that what is made of a part stays small whatever the size of a batch."""
    import numpy as np

    for batch in batches:
        if not len(batch):
            continue
        part = np.cumsum([len(x) if x is not None else 0 for x in batch[column]]) // chars
        cuts = np.append(np.flatnonzero(np.diff(part, prepend=-1)), len(batch))
        for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
            yield batch.iloc[lo:hi]


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs but for the rows with an id and a hash of the text in gone (_id, _key); columns of any names."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    left = rows.join(gone.distinct(), F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key")), "left_anti")
    return left.select(*[F.col(f"row.`{c}`") for c in docs.columns])


#: rows of one long that are broadcast (about 100 MB at most); beyond it the join is a shuffle
BROADCAST_IDS = 1_000_000


def few(ids: DataFrame) -> DataFrame:
    """ids (a narrow table) marked for a broadcast if there are no more than BROADCAST_IDS of them."""
    return F.broadcast(ids) if ids.limit(BROADCAST_IDS + 1).count() <= BROADCAST_IDS else ids
