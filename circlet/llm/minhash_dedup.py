"""Near-duplicate documents by bottom-k sketches.

A document is the set of hashes of its word shingles; its sketch is the K
smallest of them, from one hash function.

1. Documents of equal word sequences are one class, which has a number.
2. Inverted lists of the retained values.  A pair at the threshold shares so
   many values (``least_shared``, five standard deviations below the mean)
   that it also shares one of those that are left when each sketch drops its
   most frequent ones; only these make candidates, so that a passage that
   stands in very many documents hardly makes any.
3. First, lists of up to LIST classes give the pairs of neighbours by size.
   Of its longer lists a class goes to those of its FIRST_LISTS least values
   only; they are dealt in blocks and compared by their sketches (here of WIDE
   values) within a block, and a spanning forest of the pairs that look alike
   leaves a task.  So a large group of copies gives links in proportion to its
   size.
4. The union of two sketches, below the smaller of their last values, gives an
   estimate; what is far below the threshold goes.
5. The rest is verified on the full sets of shingles.
6. All lists that hold several components are compared again: all pairs of a
   list whose members are in different components by then, and without a
   forest.  So no pair that looks alike is left unverified, but where its
   documents are linked already.

Lists with more than 1/HOT_PARTS of all places are hot: there are fewer than
HOT_PARTS of them, so what is known of them is broadcast to their rows.

Defined results: a null text, an empty one and one without words has an empty
set and links with nothing; of fewer words than a shingle has, the whole
sequence is the one shingle.  Rows with a null id are linked like others; a
component's id is the smallest that isn't null.  A row with a null id is kept
only if its component has no id at all, and then in one class of it.  Rows that
share an id and text are one document; rows that share an id only are linked
by their own texts.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import discard, few, groups, materialise, slices, without
from .components import components

K = 64
#: values (their upper 32 bits) kept of documents in long lists; sets up to that size are compared as a whole within the blocks
WIDE = 512
LIST = 40
#: long lists that a class goes to in the first pass
FIRST_LISTS = 4
BLOCK = 1024
#: fewer lists than this can be hot, whatever the input
HOT_PARTS = 1000
_MIX = np.uint64(0x9E3779B97F4A7C15)
_CACHE = 500_000


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def shingle_hashes(text: str | None, n: int, known: dict) -> np.ndarray:
    """The set of hashes of a text's n-word shingles, sorted."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    n = min(n, len(words))
    out = np.full(len(h) - n + 1, np.uint64(n))
    for k in range(n):
        out = (out ^ h[k : len(h) - n + 1 + k]) * _MIX
        out ^= out >> np.uint64(31)
    return np.unique(out)


def least_shared(size: int, k: int, percent: int) -> int:
    """Values that the sketches of a pair at the threshold share at least."""
    t = percent / 100
    if size <= t * k:  # any partner has its whole set in its sketch as well
        return max(1, math.ceil(t * size - 1e-9))
    m = min(size, k)
    return max(1, math.floor(t * m - 5 * math.sqrt(t * (1 - t) * m)))


def _sketch(n: int, k: int, batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    known = _Hashes()
    for batch in batches:
        size, sketch, same = [], [], []
        for text in batch:
            found = shingle_hashes(text, n, known)
            size.append(len(found))
            sketch.append(found[:k].view(np.int64).copy())
            same.append(xxhash.xxh128_digest(b" ".join((text or "").encode("utf-8", "replace").lower().split())) if len(found) else None)
        yield pd.DataFrame({"size": size, "sketch": sketch, "same": same})


def sketches(docs: DataFrame, shingle: int, k: int = K) -> DataFrame:
    """doc_id, key (a hash of the text), size, sketch (ascending as unsigned) and same (a digest of the words, null without words) of each row."""

    @F.pandas_udf("size long, sketch array<long>, same binary")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return _sketch(shingle, k, batches)

    return materialise(docs.select("doc_id", F.xxhash64("text").alias("key"), judge(F.col("text")).alias("s")).select("doc_id", "key", "s.*"), "sketches")


def _texts(docs: DataFrame, used: DataFrame) -> DataFrame:
    """rep and text of the classes in used (rep, doc_id, key): ids and hashes only are broadcast or, if many, shuffled with the texts."""
    rows = docs.select("doc_id", "text").where("text is not null")
    one = used.select("rep", F.col("doc_id").alias("_id"), F.col("key").alias("_key"))
    return rows.join(few(one), F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_key"))).select("rep", "text").dropDuplicates(["rep"])


def _wide(docs: DataFrame, used: DataFrame, shingle: int) -> DataFrame:
    """rep and wide, a sketch of WIDE values, of the classes in used."""

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for part in slices(batches):
            yield pd.DataFrame({"rep": part["rep"], "wide": [(shingle_hashes(t, shingle, known)[:WIDE] >> np.uint64(32)).astype(np.uint32).view(np.int32) for t in part["text"]]})

    return _texts(docs, used).mapInPandas(judge, "rep long, wide array<int>")


#: in place of values that a sketch doesn't have
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def estimates(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Similarity of pairs of sketches of equal length (rows), from their union up to the smaller of their last values; and how many values of the union that is."""
    limit = np.minimum(left[:, -1], right[:, -1])[:, None]
    both = np.concatenate([left, right], axis=1)
    both = np.where((both <= limit) & (both != _NONE), both, _NONE)
    both.sort(axis=1)
    real = both != _NONE
    shared = ((both[:, 1:] == both[:, :-1]) & real[:, 1:]).sum(axis=1)
    seen = np.maximum(real.sum(axis=1) - shared, 1)
    return shared / seen, seen


def _padded(rows, k: int, kind: type) -> np.ndarray:
    out = np.full((len(rows), k), _NONE)
    for i, row in enumerate(rows):
        row = np.asarray(row, kind)[:k]
        out[i, : len(row)] = row.view(np.uint64 if kind is np.int64 else np.uint32)
    return out


def _may_be(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs of sketches don't speak against the threshold, and their estimates.  sizes: of both sets together.

    The values seen are drawn from the union without replacement: five standard deviations less are allowed, none
    if all of it is seen.
    """
    t = percent / 100
    about, seen = estimates(left, right)
    union = np.maximum(sizes / (1 + t), 2)
    spread = np.sqrt(t * (1 - t) / seen * np.clip((union - seen) / (union - 1), 0, 1))
    return about >= t - 5 * spread - 1e-9, about


def _forest(a: np.ndarray, b: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
    """Pairs (their numbers) of a spanning forest that prefers large weights."""
    order, root, out = np.argsort(-weight, kind="stable"), list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for lo in range(0, len(order), 4096):
        part = order[lo : lo + 4096]
        top = np.array([find(x) for x in range(n)])
        for e in part[top[a[part]] != top[b[part]]]:
            x, y = find(a[e]), find(b[e])
            if x != y:
                root[max(x, y)] = min(x, y)
                out.append(e)
    return np.array(out, np.int64)


def _marks(own: list[np.ndarray]) -> np.ndarray:
    """A row for each array, a column for each value that two of them have or more: 1 where it's there."""
    if not sum(map(len, own)):
        return np.zeros((len(own), 1), np.float32)
    values, at, n = np.unique(np.concatenate(own), return_inverse=True, return_counts=True)
    column, row = (np.cumsum(n > 1) - 1)[at], np.repeat(np.arange(len(own)), [len(x) for x in own])
    often = n[at] > 1
    out = np.zeros((len(own), max(1, int((n > 1).sum()))), np.float32)
    out[row[often], column[often]] = 1
    return out


def _blocks(percent: int, k: int, forest: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """a, b: the pairs of a block of a list, or of two blocks, that look alike and are in different components."""
    for part in groups(batches, ["value", "p", "q"]):
        sub, rep, size, component = (part[c].to_numpy() for c in ("sub", "rep", "size", "component"))
        p, q, here = part["p"].iloc[0], part["q"].iloc[0], part["value"].iloc[0]
        rows = np.arange(len(part)) if p == q else np.flatnonzero(sub == p)
        cols = rows if p == q else np.flatnonzero(sub == q)
        if not len(rows) or not len(cols):
            continue
        wide = _padded(part["wide"].to_list(), WIDE, np.int32)
        has = _marks([w[w != _NONE] for w in wide[:, :k]])
        need = np.array([least_shared(int(s), k, percent) for s in size], np.float32)
        shared = has[rows] @ has[cols].T
        fine = (shared >= np.minimum(need[rows][:, None], need[cols][None, :])) & (component[rows][:, None] != component[cols][None, :])
        fine &= (np.minimum(size[rows][:, None], size[cols][None, :]) * 100) >= (np.maximum(size[rows][:, None], size[cols][None, :]) * percent)
        if p == q:
            fine &= np.tri(len(rows), k=-1, dtype=bool).T
        if not forest and fine.any():
            # a pair that shares several lists is looked at in that of the least value
            own = [np.asarray(x, np.int64) for x in part["places"]]
            before = _marks([x[x < here] for x in own])
            fine &= before[rows] @ before[cols].T == 0
        i, j = np.nonzero(fine)
        i, j = rows[i], cols[j]
        alike, about = np.zeros(len(i), bool), np.zeros(len(i))
        for x in range(0, len(i), 4096):
            a, b, at = i[x : x + 4096], j[x : x + 4096], np.arange(x, min(x + 4096, len(i)))
            for width in (k, WIDE):
                sure, close = _may_be(wide[a, :width], wide[b, :width], size[a] + size[b], percent)
                a, b, at, close = a[sure], b[sure], at[sure], close[sure]
            alike[at], about[at] = True, close
        i, j, about = i[alike], j[alike], about[alike]
        if forest and len(i) > 2 * len(part):
            kept = _forest(i, j, about, len(part))
            i, j = i[kept], j[kept]
        if len(i):
            yield pd.DataFrame({"a": np.minimum(rep[i], rep[j]), "b": np.maximum(rep[i], rep[j])})


def _by_list(rows: DataFrame, lists: DataFrame, total: int) -> DataFrame:
    """rows joined with lists (value, n and more, a row for each) by value, those of hot lists by a broadcast."""
    hot = F.col("n") * HOT_PARTS > total
    often = F.broadcast(lists.where(hot))
    return rows.join(F.broadcast(lists.where(hot).select("value")), "value", "left_anti").join(lists.where(~hot), "value").unionByName(rows.join(often, "value"))


def _first_pairs(places: DataFrame, lists: DataFrame, wide: DataFrame, total: int, percent: int, k: int) -> DataFrame:
    """a, b: neighbours by size in the short lists; forests of the blocks of the long ones.

    The block is a hash of the list as well, so that the members of a group meet in other blocks of their other lists.
    """
    rows = _by_list(places, lists, total)
    by_size = Window.partitionBy("value").orderBy("size", "rep")
    one = rows.where(F.col("n") <= LIST).select(F.struct("rep", "size").alias("x"), F.lag(F.struct("rep", "size")).over(by_size).alias("y")).where("y is not null")
    short = one.select(F.least("x.rep", "y.rep").alias("a"), F.greatest("x.rep", "y.rep").alias("b"), F.col("x.size").alias("size_a"), F.col("y.size").alias("size_b"))
    least = Window.partitionBy("rep").orderBy("value")
    long = rows.where(F.col("n") > LIST).withColumn("place", F.row_number().over(least)).where(F.col("place") <= FIRST_LISTS)
    long = long.withColumn("p", F.pmod(F.xxhash64("rep", "value"), F.ceil(F.col("n") / BLOCK)).cast("int")).select("value", "rep", F.col("rep").alias("component"), F.col("p").alias("sub"), "p", F.col("p").alias("q"))
    return _sized(short, percent), _compared(long.join(wide, "rep"), percent, k, True)


def _second_pairs(places: DataFrame, lists: DataFrame, label: DataFrame, wide: DataFrame, total: int, percent: int, k: int) -> tuple[DataFrame, DataFrame]:
    """a, b: all pairs of a list between different components.  Rows of a long list's largest component meet those outside it only."""
    rows = materialise(places.join(label.withColumnRenamed("node", "rep"), "rep", "left").withColumn("component", F.coalesce("component", "rep")), "places")
    counts = rows.groupBy("value", "component").agg(F.count("*").alias("n")).groupBy("value")
    open_lists = counts.agg(F.sum("n").alias("n"), F.count("*").alias("several"), F.max(F.struct("n", "component")).alias("top")).where("several > 1")
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(n / BLOCK)).cast("int")
    open_lists = materialise(open_lists.select("value", "n", F.col("top.component").alias("main"), blocks(F.col("n") - F.col("top.n")).alias("m"), blocks(F.col("top.n")).alias("m_main")), "lists")
    rows = _by_list(rows, open_lists, total)
    short = rows.where(F.col("n") <= LIST)
    a, b = (short.select("value", F.col("rep").alias(r), F.col("size").alias(f"size_{r}"), F.col("component").alias(f"component_{r}")) for r in ("a", "b"))
    short = a.join(b, "value").where("a < b and component_a <> component_b")
    # blocks of rows outside the largest component are numbered from 0, its own from m
    is_main = F.col("component") == F.col("main")
    long = rows.where(F.col("n") > LIST).withColumn("sub", F.when(is_main, F.col("m") + F.pmod(F.xxhash64("rep"), F.col("m_main"))).otherwise(F.pmod(F.xxhash64("rep"), F.col("m"))).cast("int"))
    upto = F.when(is_main, F.col("m")).otherwise(F.col("m") + F.col("m_main")) - 1
    pair = F.transform(F.sequence(F.lit(0), upto), lambda o: F.struct(F.least("sub", o).alias("p"), F.greatest("sub", o).alias("q")))
    long = long.select("value", "rep", "component", "sub", F.explode(pair).alias("pq")).select("value", "rep", "component", "sub", "pq.p", "pq.q")
    return _sized(short, percent), _compared(long.join(wide, "rep"), percent, k, False)


def _sized(pairs: DataFrame, percent: int) -> DataFrame:
    return pairs.where(F.least("size_a", "size_b") * 100 >= F.greatest("size_a", "size_b") * percent).select("a", "b").distinct()


def _compared(rows: DataFrame, percent: int, k: int, forest: bool) -> DataFrame:
    order = ["value", "p", "q"]
    return rows.repartition(*order).sortWithinPartitions(*order).mapInPandas(lambda b: _blocks(percent, k, forest, b), "a long, b long").distinct()


def _alike(pairs: DataFrame, reps: DataFrame, percent: int, k: int) -> DataFrame:
    """The pairs whose sketches don't speak against them."""

    @F.pandas_udf("boolean")
    def alike(left: pd.Series, right: pd.Series, sizes: pd.Series) -> pd.Series:
        out = [np.zeros(0, bool)]
        for x in range(0, len(left), 4096):
            part = slice(x, x + 4096)
            out.append(_may_be(_padded(left.iloc[part], k, np.int64), _padded(right.iloc[part], k, np.int64), sizes.to_numpy()[part], percent)[0])
        return pd.Series(np.concatenate(out))

    own = lambda r: reps.select(F.col("rep").alias(r), F.col("sketch").alias(f"sketch_{r}"), F.col("size").alias(f"size_{r}"))
    return pairs.join(own("a"), "a").join(own("b"), "b").where(alike("sketch_a", "sketch_b", F.col("size_a") + F.col("size_b"))).select("a", "b")


def verify(pairs: DataFrame, docs: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """a, b: the pairs whose sets of shingles are similar."""
    used = reps.select("rep", "doc_id", "key").join(few(pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct()), "rep", "left_semi")
    texts = _texts(docs, used)
    both = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("text_a")), "a").join(texts.select(F.col("rep").alias("b"), F.col("text").alias("text_b")), "b")

    @F.pandas_udf("boolean")
    def similar(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        known = _Hashes()
        for left, right in batches:
            out = np.zeros(len(left), bool)
            for i, (x, y) in enumerate(zip(left, right, strict=True)):
                x, y = shingle_hashes(x, shingle, known), shingle_hashes(y, shingle, known)
                common = len(np.intersect1d(x, y, assume_unique=True))
                out[i] = 100 * common >= percent * (len(x) + len(y) - common)
            yield pd.Series(out)

    return both.withColumn("ok", similar("text_a", "text_b")).where("ok").select("a", "b")


def _linked(docs: DataFrame, shingle: int, percent: int, k: int) -> DataFrame:
    """doc_id, key, n_shingles, component_id and kept of each row."""
    sketched = sketches(docs, shingle, k)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")).alias("first")
    classes = sketched.where("same is not null").groupBy("same").agg(first, F.first(F.struct("size", "sketch")).alias("s"))
    reps = materialise(classes.select(F.monotonically_increasing_id().alias("rep"), "same", "first.doc_id", "first.key", "s.size", "s.sketch"), "classes")
    values = reps.select("rep", "size", F.explode("sketch").alias("value"))
    shared = materialise(values.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    frequent = Window.partitionBy("rep").orderBy(F.desc("n"), "value")
    t = percent / 100
    m = F.least(F.col("size"), F.lit(k))
    need = F.when(F.col("size") <= t * k, F.ceil(t * F.col("size") - 1e-9)).otherwise(F.floor(t * m - 5 * F.sqrt(t * (1 - t) * m)))
    n_places = shared.agg(F.sum("n")).first()[0] or 0
    places = _by_list(values, shared, n_places).withColumn("place", F.row_number().over(frequent)).where(F.col("place") >= F.greatest(need, F.lit(1))).select("value", "rep", "size")
    places = materialise(places, "places")
    lists = materialise(places.groupBy("value").agg(F.count("*").alias("n")).where("n > 1"), "lists")
    total = lists.agg(F.sum("n")).first()[0] or 0
    in_long = _by_list(places, lists.where(F.col("n") > LIST), total).groupBy("rep").agg(F.collect_list("value").alias("places"))
    in_long = materialise(in_long.join(reps.select("rep", "size", "doc_id", "key"), "rep"), "in-long")
    wide = materialise(_wide(docs, in_long, shingle).join(in_long.select("rep", "size", "places"), "rep"), "wide")

    def links(found: tuple[DataFrame, DataFrame], done: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        short, long = (materialise(x, "pairs") for x in found)
        pairs = _alike(short, reps, percent, k).unionByName(long).distinct()
        pairs = materialise(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        discard(short)
        discard(long)
        return pairs, materialise(verify(pairs, docs, reps, shingle, percent), "links")

    first_pairs, linked = links(_first_pairs(places, lists, wide, total, percent, k), None)
    label = materialise(components(linked), "labels")
    pairs, more = links(_second_pairs(places, lists, label, wide, total, percent, k), first_pairs)
    discard(pairs)
    labels = [label]
    if more.limit(1).count():
        label = materialise(components(linked.unionByName(more)), "labels")
        labels.append(label)
    of = reps.join(label.withColumnRenamed("node", "rep"), "rep", "left").select("rep", F.col("same").alias("_same"), "doc_id", F.coalesce("component", "rep").alias("component"))
    names = of.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min("rep").alias("main"))
    of = of.drop("doc_id").join(names, "component").select("_same", "component_id", (F.col("rep") == F.col("main")).alias("main"))
    rows = sketched.join(of, F.col("same") == F.col("_same"), "left")
    nameless = F.col("component_id").isNull() & F.coalesce("main", F.lit(True))
    component = F.when(F.col("same").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.when(F.col("same").isNull(), True).otherwise(F.coalesce(F.col("doc_id") == F.col("component_id"), nameless))
    out = materialise(rows.select("doc_id", "key", F.col("size").alias("n_shingles"), component.alias("component_id"), kept.alias("kept")), "near-duplicates")
    for own in (sketched, reps, shared, places, lists, in_long, wide, first_pairs, linked, more, *labels):
        discard(own)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, k: int = K) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of each row."""
    return _linked(docs, shingle, percent, k).drop("key")


def dedup(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """One document of each group: that with the smallest id.  Rows of one id and text go or stay together."""
    return without(docs, _linked(docs, shingle, percent, K).where("not kept").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))
