"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are scaled to length 1 and projected on random Gaussian directions;
floor((projection + offset) / WIDTH) of K projections make a bucket key, in T
tables.  K follows from the number of vectors, so that unlike vectors share a
bucket with about COMPANY others, which fill one block, and T from K, so that a
pair at the threshold meets in some table with probability RECALL or more.  A
vector is sent to each of its buckets as it is stored (four bytes a component if
that is its type), with its keys.  The vectors of a bucket are compared by cosine
in double precision, in blocks of BLOCK x BLOCK; a large bucket is dealt over many
tasks.  Only counts and, of each block, the links that tell its
components leave a task; a pair counts in the first table in which it meets.

Equal vectors are one class with a weight; links are found between classes.

Defined results: vectors that are null, empty, zero or hold null or non-finite
components link with nothing.  Vectors of unlike lengths don't link.  Rows with
a null id link with nothing and are kept.  Rows that are equal in id and vector
count once; rows that share an id only are linked by their own vectors.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, group_bounds, key_runs, materialise
from .components import components

WIDTH = 2.0
#: for a pair just at the threshold; a closer one meets more often
RECALL = 0.97
#: vectors that an unlike vector meets in a bucket, about: comparing so many at once costs less than sending each vector to more tables
COMPANY = 500
BLOCK = 2048
_SEED = 20240229


def collision(distance: float, width: float = WIDTH) -> float:
    """Probability that two points at a distance share the value of one projection."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(rows: int, threshold: float, recall: float = RECALL) -> tuple[int, int]:
    """Projections of a table, and tables."""
    near, far = collision(math.sqrt(max(1e-9, 2 - 2 * threshold))), collision(math.sqrt(2))
    k = max(4, math.ceil(math.log(max(rows, 1) / COMPANY) / math.log(1 / far)))
    return k, math.ceil(math.log(1 - recall) / math.log(1 - near**k))


def bucket_keys(unit: np.ndarray, k: int, tables: int) -> np.ndarray:
    """int32 keys, (vectors, tables)."""
    rng = np.random.default_rng([_SEED, unit.shape[1]])
    direction = rng.standard_normal((tables * k, unit.shape[1]))
    offset = rng.uniform(0, WIDTH, tables * k)
    cell = np.floor((unit @ direction.T + offset) / WIDTH).astype(np.int64).reshape(len(unit), tables, k)
    mix = rng.integers(1, 1 << 62, k, dtype=np.int64) | 1
    key = (cell * mix).sum(axis=2)
    return (key ^ (key >> 29) ^ (key >> 47)).astype(np.int32)


def _valid(embedding) -> F.Column:
    fine = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(embedding) > 0) & fine & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _scaled(x: np.ndarray) -> np.ndarray:
    """Rows in doubles, each by that power of two that brings its largest component near 1: squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _sign(k: int, tables: int, kind: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        vectors = [np.asarray(v, kind) for v in batch["embedding"]]
        keys: list = [None] * len(vectors)
        lengths = np.array([len(v) for v in vectors])
        for n in np.unique(lengths):
            at = np.flatnonzero(lengths == n)
            x = _scaled(np.stack([vectors[i] for i in at]))
            found = bucket_keys(x / np.linalg.norm(x, axis=1, keepdims=True), k, tables)
            for i, row in zip(at, found, strict=True):
                keys[i] = row
        yield pd.DataFrame({"rep": batch["rep"], "weight": batch["weight"], "vector": [v.tobytes() for v in vectors], "keys": keys})


def _links(left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    one, other, out = np.linalg.norm(left, axis=1), np.linalg.norm(right, axis=1), np.empty((len(left), len(right)), bool)
    for x in range(0, len(left), 256):
        out[x : x + 256] = (left[x : x + 256] @ right.T) / (one[x : x + 256, None] * other[None, :]) >= threshold
    return out


def _compare(threshold: float, kind: str, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """kind 0: a has n more links; kind 1: a and b are linked, perhaps by others."""
    for frame in key_runs(batches, ["t", "key", "p", "q"]):
        bounds = group_bounds(frame, ["t", "key", "p", "q"])
        rep, weight, sub, p, q, t = (frame[c].to_numpy() for c in ("rep", "weight", "sub", "p", "q", "t"))
        out_a, out_n, edge_a, edge_b = [], [], [], []
        for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
            if hi - lo < 2:
                continue
            vectors = [np.frombuffer(v, kind) for v in frame["vector"].iloc[lo:hi]]
            length = np.array([len(v) for v in vectors])
            x = np.zeros((hi - lo, length.max()), kind)
            for r, v in enumerate(vectors):
                x[r, : len(v)] = v
            x = _scaled(x)
            keys = np.stack(frame["keys"].iloc[lo:hi].to_list())
            one = p[lo] == q[lo]
            rows = np.arange(hi - lo) if one else np.flatnonzero(sub[lo:hi] == p[lo])
            cols = rows if one else np.flatnonzero(sub[lo:hi] == q[lo])
            if not len(rows) or not len(cols):
                continue
            with np.errstate(invalid="ignore", divide="ignore"):
                found = _links(x[rows], x[cols], threshold) & (length[rows][:, None] == length[cols][None, :])
            if one:
                found &= np.tri(len(rows), k=-1, dtype=bool).T
            i, j = np.nonzero(found)
            if not len(i):
                continue
            earlier = np.zeros(len(i), bool)
            for u in range(t[lo]):
                earlier |= keys[rows[i], u] == keys[cols[j], u]
            i, j = rows[i[~earlier]] + lo, cols[j[~earlier]] + lo
            if not len(i):
                continue
            n = np.bincount(i - lo, weights=weight[j], minlength=hi - lo) + np.bincount(j - lo, weights=weight[i], minlength=hi - lo)
            used = np.flatnonzero(n)
            out_a.append(rep[lo + used])
            out_n.append(n[used].astype(np.int64))
            label = np.arange(hi - lo)
            while True:
                least = label.copy()
                np.minimum.at(least, i - lo, label[j - lo])
                np.minimum.at(least, j - lo, label[i - lo])
                least = least[least]
                if (least == label).all():
                    break
                label = least
            moved = np.flatnonzero(label != np.arange(hi - lo))
            edge_a.append(rep[lo + moved])
            edge_b.append(rep[lo + label[moved]])
        if out_a:
            a, n = np.concatenate(out_a), np.concatenate(out_n)
            yield pd.DataFrame({"kind": 0, "a": a, "b": a, "n": n})
            a, b = np.concatenate(edge_a), np.concatenate(edge_b)
            yield pd.DataFrame({"kind": 1, "a": a, "b": b, "n": np.int64(0)})


def near_duplicates(vectors: DataFrame, threshold: float = 0.9, vec_id: str = "vec_id", embedding: str = "embedding", recall: float = RECALL) -> DataFrame:
    """vec_id, n_links, component_id and kept of each row."""
    single = vectors.schema[embedding].dataType.elementType.typeName() == "float"
    kind, numbers = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast(numbers).alias("embedding"))
    valid = rows.where(_valid(F.col("embedding")) & F.col("vec_id").isNotNull())
    classes = valid.groupBy("embedding").agg(F.min("vec_id").alias("label"), F.countDistinct("vec_id").alias("weight"))
    classes = materialise(classes.select(F.monotonically_increasing_id().alias("rep"), "*"), "vectors")
    k, tables = plan(classes.count(), threshold, recall)
    signed = classes.mapInPandas(lambda b: _sign(k, tables, kind, b), "rep long, weight long, vector binary, keys array<int>")
    signed = materialise(signed, "vector-keys")
    # ids only are dealt to the blocks; the vectors follow once it's known which
    places = signed.select("rep", F.posexplode("keys").alias("t", "key"))
    blocks = places.groupBy("t", "key").agg(F.count("*").alias("size")).where("size > 1").select("t", "key", F.ceil(F.col("size") / BLOCK).cast("int").alias("n"))
    dealt = places.join(blocks, ["t", "key"]).withColumn("sub", F.pmod(F.xxhash64("rep"), F.col("n")).cast("int"))
    pair = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda o: F.struct(F.least("sub", o).alias("p"), F.greatest("sub", o).alias("q")))
    dealt = dealt.select("rep", "t", "key", "sub", F.explode(pair).alias("pq")).select("rep", "t", "key", "sub", "pq.p", "pq.q").join(signed, "rep")
    order = ["t", "key", "p", "q"]
    dealt = dealt.repartition(*order).sortWithinPartitions(*order)
    found = materialise(dealt.mapInPandas(lambda b: _compare(threshold, kind, b), "kind int, a long, b long, n long"), "vector-links")
    discard(signed)
    counts = found.where("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    joined = components(found.where("kind = 1")).withColumnRenamed("node", "rep")
    per_class = classes.join(counts, "rep", "left").join(joined, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    names = per_class.groupBy("component").agg(F.min("label").alias("component_id"))
    per_class = per_class.join(names, "component").select(F.col("embedding").alias("_at"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component_id")
    keyed = rows.withColumn("_own", F.when(_valid(F.col("embedding")) & F.col("vec_id").isNotNull(), F.col("embedding")))
    out = keyed.join(per_class, F.col("_own") == F.col("_at"), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.cast("long").alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))
