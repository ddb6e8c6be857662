"""Removal of repeated byte strings: of two equal strings of LENGTH bytes, the later one goes.

The result is that of a generalised suffix array over all texts, but suffixes
are never sorted over the corpus (see the README on why Burrows-Wheeler
transforms aren't merged here).  Instead a window of LENGTH bytes is anchored
at the smallest hash among the grams inside it, which equal windows share:

1. Each text is cut into runs of successive windows with the same anchor.  A
   run's key is the anchor and a hash of all bytes that the run covers.  Of
   equal runs within some MB of texts only the first goes on; later ones are
   removed, so that frequent passages are few rows.
2. Runs are dealt and sorted by anchor.  Of equal runs, all but the first are
   removed.  An anchor with unlike runs (where a repeated passage begins or
   ends) sends the first one of each to the next step, without windows that
   small hashes of the bytes around the anchor show to be in no other run.
3. Of what is left every window is hashed, and of equal windows all but the
   first are removed.
4. The removed bytes of a text are the union of its removed windows.

Hashes of windows and of runs are pairs of 64 bits (polynomials over random
values of the bytes, at two bases); bytes aren't compared.  Among n different
windows some two are taken for equal with odds of about n * n / 2 ** 129: one
in 10 ** 13 for 10 ** 13 windows (10 TB).  Runs are compared by 64 bits beside
the anchor's 64.

Defined results: a null text is empty; texts shorter than LENGTH lose nothing.
Matches never cross documents.  "Earlier" is by doc_id, then by position; null
ids come first.  Rows with equal ids are ordered by a hash of the text; rows
that are equal in both are one document.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import group_bounds, key_runs, materialise, slices

LENGTH = 100
GRAM = 40
_BLOCK = 1 << 20
_SEED = 20240301


def _tables() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(_SEED)
    value = rng.integers(0, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + rng.integers(0, 2, (2, 256), dtype=np.uint64)
    base = rng.integers(0, 1 << 62, 2, dtype=np.uint64) * np.uint64(4) + np.uint64(3)
    return value, base


_VALUE, _BASE = _tables()
_POWERS: list[tuple[np.ndarray, np.ndarray]] = []


def _powers(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Powers of the bases and of their inverses modulo 2**64, n or more."""
    if not _POWERS or len(_POWERS[0][0]) < n:
        size = 1 << max(17, (n - 1).bit_length())
        made = []
        for b in _BASE:
            inverse = np.array([pow(int(b), -1, 1 << 64)], np.uint64)
            pair = []
            for x in (np.array([b], np.uint64), inverse):
                p = np.ones(size, np.uint64)
                done = 1
                while done < size:
                    step = min(done, size - done)
                    p[done : done + step] = p[:step] * (x ** np.uint64(done))
                    done += step
                pair.append(p)
            made.append(tuple(pair))
        _POWERS[:] = made
    return _POWERS


class Rolling:
    """Hashes of any substring of some bytes."""

    def __init__(self, data: np.ndarray, which: int):
        power, self.inverse = (p[: len(data) + 1] for p in _powers(len(data) + 1)[which])
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_VALUE[which][data] * power[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.inverse[start]


def _window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w successive values."""
    n = len(x)
    m = -(-n // w) * w
    y = np.full(m, np.iinfo(np.uint64).max, np.uint64)
    y[:n] = x
    y = y.reshape(-1, w)
    ahead = np.minimum.accumulate(y, axis=1).ravel()
    back = np.minimum.accumulate(y[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - w + 1], ahead[w - 1 : n])


def _mixed(x: np.ndarray) -> np.ndarray:
    return (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)


def _anchors(grams: np.ndarray, least: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Where the anchor of each run stands: first from the start of the run's last window on, as all its windows hold it."""
    at = last.copy()
    rest = np.flatnonzero(grams[at] != least)
    while len(rest):
        at[rest] += 1
        rest = rest[grams[at[rest]] != least[rest]]
    return at


def _half(length: int, gram: int) -> int:
    """A window has so many bytes before its anchor or so many after it."""
    return (length - gram + 1) // 2


def _mark(hashes: Rolling, start: np.ndarray, end: np.ndarray, there: np.ndarray) -> np.ndarray:
    """A small hash of the bytes; 0 where they aren't all in the run."""
    out = np.zeros(len(there), np.int64)
    out[there] = 1 + (_mixed(hashes.of(start[there], end[there])) >> np.uint64(40)).astype(np.int64) % (_MARKS - 1)
    return out


def runs(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """anchor, two hashes, and place of each run (see _place)."""
    n = len(data)
    if n < length:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.uint64, np.int64))
    one, two = Rolling(data, 0), Rolling(data, 1)
    at = np.arange(n - gram + 1)
    grams = _mixed(one.of(at, at + gram))
    least = _window_min(grams, length - gram + 1)
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | (grams[: len(least) - 1] == least[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, len(least)))
    end = start + count + length - 1
    at, half = _anchors(grams, least[start], start + count - 1), _half(length, gram)
    before = _mark(one, at - half, at, at - half >= start)
    after = _mark(one, at + gram, at + gram + half, at + gram + half <= end)
    return least[start], one.of(start, end), two.of(start, end), _place(start, before, after, at - (start + count - 1), count)


def _key(doc_id: str = "doc_id") -> F.Column:
    """The id, nulls first; never null, as pandas has no nulls among integers."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(-(1 << 63)))


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


#: windows of a run, less than so many
_COUNTS = 64
_MARKS = 1024


def _place(start: np.ndarray, before: np.ndarray, after: np.ndarray, ahead: np.ndarray, count: np.ndarray) -> np.ndarray:
    """One integer: a run's start, the marks, the anchor's distance from the last window's start, the number of windows."""
    return ((((start * _MARKS + before) * _MARKS) + after) * _COUNTS + ahead) * _COUNTS + count


def _unplace(place: np.ndarray) -> tuple[np.ndarray, ...]:
    rest, count = np.divmod(np.abs(place), _COUNTS)
    rest, ahead = np.divmod(rest, _COUNTS)
    rest, after = np.divmod(rest, _MARKS)
    start, before = np.divmod(rest, _MARKS)
    return start, before, after, ahead, count


def _shared(group: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """Whether another row of the group has the same mark."""
    _, at, counts = np.unique(group * _MARKS + mark, return_inverse=True, return_counts=True)
    return (counts[at] > 1) & (mark > 0)


def _cut(length: int, gram: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """_id, _key, anchor, h (of the run's bytes), place of each run of each text.

    A run that stands before in these texts has a negative place: it is removed, whatever others do.
    """
    for batch in slices(batches):
        out = []
        for i, text in enumerate(batch["text"]):
            anchor, h1, h2, place = runs(np.frombuffer(text.encode("utf-8", "replace"), np.uint8), length, gram)
            h = (h1 ^ (h2 >> np.uint64(17))) * np.uint64(0xBF58476D1CE4E5B9) + h2 + (place % _COUNTS).astype(np.uint64)
            out.append((np.full(len(anchor), i), _signed(anchor), _signed(h), place))
        at, anchor, h, place = (np.concatenate(x) for x in zip(*out, strict=True))
        if not len(at):
            continue
        doc, key = batch["_id"].to_numpy()[at], batch["_key"].to_numpy()[at]
        order = np.lexsort((place, key, doc, h, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (h[order][1:] != h[order][:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        again = np.logical_or.reduce([x[order] != x[order][first] for x in (doc, key, place)])  # a repeated row has the same place
        place[order[again]] *= -1
        yield pd.DataFrame({"_id": doc, "_key": key, "anchor": anchor, "h": h, "place": place})


def _same(frame: pd.DataFrame, columns: list[str]) -> np.ndarray:
    """Whether a row is like the one before it: the same place of a row that is there several times."""
    out = np.ones(len(frame), bool)
    out[:1] = False
    for c in columns:
        v = frame[c].to_numpy()
        out[1:] &= v[1:] == v[:-1]
    return out


def _settle(half: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of runs sorted by anchor, hash and place: kind 1, to remove; kind 2, windows to be compared one by one.

    A window of two unlike runs has ``half`` bytes before its anchor in common, or that many after it; windows
    for which no other run of the anchor has the mark are in no other run.
    """

    def out(part: pd.DataFrame, kind: int, start: np.ndarray, n: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"_id": part["_id"].to_numpy(), "_key": part["_key"].to_numpy(), "start": start.astype(np.int32), "n": n.astype(np.int32), "kind": np.int32(kind)})

    def remove(part: pd.DataFrame) -> pd.DataFrame:
        start, _, _, _, n = _unplace(part["place"].to_numpy())
        return out(part, 1, start, n)

    def compare(part: pd.DataFrame, group: np.ndarray) -> pd.DataFrame:
        start, before, after, ahead, n = _unplace(part["place"].to_numpy())
        end = start + n
        middle = end + ahead - half  # windows that start before it have half or more bytes before the anchor
        start = np.where(_shared(group, before), start, np.maximum(start, middle))
        end = np.where(_shared(group, after), end, np.minimum(end, middle))
        some = end > start
        return out(part[some], 2, start[some], (end - start)[some])

    for frame in key_runs(batches, ["anchor"]):
        frame = frame[~_same(frame, ["anchor", "h", "_id", "_key", "place"])].reset_index(drop=True)
        again = frame["place"].to_numpy() < 0
        if again.any():
            yield remove(frame[again])
            frame = frame[~again].reset_index(drop=True)
            if not len(frame):
                continue
        bounds = group_bounds(frame, ["anchor"])
        group = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
        new = np.zeros(len(frame), bool)
        new[group_bounds(frame, ["anchor", "h"])[:-1]] = True
        unlike = np.bincount(group[new], minlength=len(bounds) - 1) > 1
        if not new.all():
            yield remove(frame[~new])
        found = new & unlike[group]
        if found.any():
            yield compare(frame[found], group[found])


def _hash_windows(length: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """w1, w2 of each window of the rows' runs, and its place."""
    for batch in slices(batches):
        parts = []
        for i, (text, spans) in enumerate(zip(batch["text"], batch["spans"], strict=True)):
            data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
            one, two = Rolling(data, 0), Rolling(data, 1)
            start = np.concatenate([np.arange(s["start"], s["start"] + s["n"]) for s in spans])
            parts.append((i, _signed(one.of(start, start + length)), _signed(two.of(start, start + length)), start))
        at = np.repeat([p[0] for p in parts], [len(p[1]) for p in parts])
        yield pd.DataFrame({"_id": batch["_id"].to_numpy()[at], "_key": batch["_key"].to_numpy()[at], "w1": np.concatenate([p[1] for p in parts]), "w2": np.concatenate([p[2] for p in parts]), "start": np.concatenate([p[3] for p in parts]).astype(np.int32)})


def _later(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of windows sorted by hashes and place, all but the first of equal ones; a place that is there several times is one."""
    held: tuple | None = None
    for frame in batches:
        if not len(frame):
            continue
        columns = [frame[c].to_numpy() for c in ("w1", "w2", "_id", "_key", "start")]
        if held is not None:
            columns = [np.append(h, c) for h, c in zip(held, columns, strict=True)]
        w1, w2, *place = columns
        new = np.ones(len(w1), bool)
        new[1:] = (w1[1:] != w1[:-1]) | (w2[1:] != w2[:-1])
        first = np.flatnonzero(new)[np.cumsum(new) - 1]
        later = np.logical_or.reduce([c != c[first] for c in place])
        held = tuple(c[first[-1:]] for c in columns)
        if later.any():
            yield pd.DataFrame(dict(zip(("_id", "_key", "start"), (c[later] for c in place), strict=True)))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.where("text is not null").select(_key().alias("_id"), F.xxhash64("text").alias("_key"), "text")


def _settled(docs: DataFrame, length: int, gram: int) -> DataFrame:
    cut = _rows(docs).mapInPandas(lambda b: _cut(length, gram, b), "_id long, _key long, anchor long, h long, place long")
    # runs that are removed anyway wait for no other: they are dealt by document, so that a passage of many documents isn't one key
    dealt = cut.repartition(F.when(F.col("place") < 0, F.xxhash64("_id", "_key")).otherwise(F.col("anchor"))).sortWithinPartitions("anchor", "h", "_id", "_key", F.abs("place"))
    half = _half(length, gram)
    return materialise(dealt.mapInPandas(lambda b: _settle(half, b), "_id long, _key long, start int, n int, kind int"), "runs")


def _late(docs: DataFrame, settled: DataFrame, length: int) -> DataFrame:
    spans = settled.where("kind = 2").groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    open_rows = _rows(docs).join(spans, ["_id", "_key"]).select("_id", "_key", "text", "spans")
    windows = open_rows.mapInPandas(lambda b: _hash_windows(length, b), "_id long, _key long, w1 long, w2 long, start int")
    sorted_windows = windows.repartition("w1").sortWithinPartitions("w1", "w2", "_id", "_key", "start")
    return materialise(sorted_windows.mapInPandas(_later, "_id long, _key long, start int"), "windows")


def removed_windows(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """_id, _key, start, n: runs of n windows to remove."""
    if length - gram + 1 >= _COUNTS:
        raise ValueError(f"length - gram has to be less than {_COUNTS - 1}")
    settled = _settled(docs, length, gram)
    late = _late(docs, settled, length)
    return settled.where("kind = 1").select("_id", "_key", "start", "n").unionByName(late.withColumn("n", F.lit(1)))


def _merge(start: np.ndarray, n: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of removed bytes: starts and ends."""
    order = np.argsort(start, kind="stable")
    lo, hi = start[order], np.maximum.accumulate((start + n + length - 1)[order])
    new = np.ones(len(lo), bool)
    new[1:] = lo[1:] > hi[:-1]
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def strip(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes) of each row."""
    gone = removed_windows(docs, length, gram)
    spans = gone.groupBy("_id", "_key").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("key"), _key().alias("id"))
    rows = rows.join(spans, (rows["id"] == spans["_id"]) & (rows["key"] == spans["_key"]), "left").select("doc_id", "text", "spans")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    def cut_out(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, all_spans in batches:
            out = []
            for text, own in zip(texts, all_spans, strict=True):
                data = text.encode("utf-8", "replace")
                removed = 0
                lo = hi = np.empty(0, np.int64)
                kept = data
                if own is not None and len(own):
                    lo, hi = _merge(np.array([s["start"] for s in own], np.int64), np.array([s["n"] for s in own], np.int64), length)
                    removed = int((hi - lo).sum())
                    kept = b"".join(data[a:b] for a, b in zip([0, *hi], [*lo, len(data)], strict=True))
                out.append((len(data), removed, len(lo), hashlib.sha256(kept).hexdigest(), kept))
            yield pd.DataFrame(out, columns=["n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return rows.select("doc_id", cut_out("text", "spans").alias("c")).select("doc_id", "c.*")
