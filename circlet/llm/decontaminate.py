"""Benchmark decontamination with a broadcast set of normalised n-grams.

Texts are lower-cased (A-Z) and cut into words of letters a-z, digits and
non-ASCII characters.  Every run of ``n`` words of a benchmark item, or the
whole of a shorter item, is a window.  Hashes of the windows are broadcast if
there are no more than BROADCAST_WINDOWS; each run of words of a document, of
every length that windows have, is looked up by its hash and then compared as
text.  With more windows the runs' places and hashes, without any text, are
joined by a shuffle, and only the found ones go back to the documents.

All of it is DataFrame operations.

Defined results: a null or empty text has no words and no hit.  Items that are
null or without words have no window.  A window of several items counts for
each; equal item ids count once; null item ids are not listed, and an item
without an id is listed nowhere, but its windows hit.  Rows that are equal in
doc_id and text get equal results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._shared import without

N = 13
BROADCAST_WINDOWS = 1_000_000
#: between words; A-Z are lower-cased later, word by word
_GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """The words of a text, their case as it is."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), _GAP), "")


def _lowered(word: Column) -> Column:
    # translate() is slow and lower() changes other letters too, so that translate() only gets words that lower() changes
    return F.when(F.lower(word) == word, word).otherwise(F.translate(word, _UPPER, _LOWER))


def _hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(_lowered(w)))


def _hash(n: int, start: Column) -> Column:
    """Of the n words from start, by the words' hashes."""
    return F.xxhash64(*[F.get("hashes", start + k) for k in range(n)])


def _runs(rows: DataFrame, n: int) -> DataFrame:
    """rows, once for the start of each run of n words; once with a null start if there is none.

    explode_outer: for explode, the optimizer would infer a filter that cuts the text into words once more.
    """
    return rows.select("*", F.explode_outer(F.when(F.size("words") >= n, F.sequence(F.lit(0), F.size("words") - n))).alias("start"))


def _run_text(n: int | Column) -> Column:
    return F.translate(F.array_join(F.slice("words", F.col("start") + 1, n), " "), _UPPER, _LOWER)


def windows(benchmark: DataFrame, n: int = N, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """length, run (the words) and items of each different window."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("words")).where(F.size("words") > 0)
    short = items.where(F.size("words") < n).select(F.size("words").alias("length"), F.translate(F.array_join("words", " "), _UPPER, _LOWER).alias("run"), "item")
    full = _runs(items, n).where("start is not null").select(F.lit(n).alias("length"), _run_text(n).alias("run"), "item")
    return full.unionByName(short).groupBy("length", "run").agg(F.collect_set("item").alias("items"))


def occurrences(docs: DataFrame, benchmark: DataFrame, n: int = N, doc_id: str = "doc_id", text: str = "text", broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """_id, _key (a hash of the text), n_words, start, length and items of each place where a window stands in a document.

    Each row of docs also gives one row with ``first`` true, be there a window or not.
    """
    held = windows(benchmark, n)
    there = {r["length"]: r["n"] for r in held.groupBy("length").agg(F.count("*").alias("n")).collect()}  # n rows at most
    lengths = sorted({n, *there})
    own = held.withColumn("hashes", F.transform(F.split("run", " "), lambda w: F.xxhash64(w)))
    own = own.select(F.col("length").alias("_length"), "run", "items", F.coalesce(*[F.when(F.col("length") == k, _hash(k, F.lit(0))) for k in lengths]).alias("hash"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.xxhash64(text).alias("_key"), words(F.col(text)).alias("words")).withColumn("hashes", _hashes(F.col("words")))
    runs = rows.select("*", F.explode_outer(F.when(F.size("words") > 0, F.sequence(F.lit(0), F.size("words") - 1))).alias("start"))
    here = {k: F.when(F.size("words") - F.col("start") >= k, _hash(k, F.col("start"))) for k in lengths}
    if len(lengths) == 1:
        runs = runs.select("*", F.lit(n).alias("length"), here[n].alias("here"))
    else:
        runs = runs.select("*", F.explode(F.array(*[F.struct(F.lit(k).alias("length"), h.alias("here")) for k, h in here.items()])).alias("r")).select("*", "r.length", "r.here")
    first = F.lit(n) == F.col("length")
    first = first & (F.coalesce("start", F.lit(0)) == 0)
    key = (F.col("here") == F.col("hash")) & (F.col("length") == F.col("_length"))
    out = ["_id", "_key", F.size("words").cast("long").alias("n_words")]
    if sum(there.values()) <= broadcast_windows:
        # two comparisons instead of an equality, which would become a join key and be computed for every run of words
        same = (_run_text(F.col("length")) <= F.col("run")) & (_run_text(F.col("length")) >= F.col("run"))
        found = runs.join(F.broadcast(own), key & same, "left").where(first | F.col("run").isNotNull())
        return found.select(*out, first.alias("first"), "start", F.when(F.col("run").isNotNull(), F.col("length")).alias("length"), "items")
    places = runs.where("here is not null").select(F.col("_id").alias("_at"), F.col("_key").alias("_at_key"), "start", "length", "here").distinct()
    hits = places.join(own, key).groupBy("_at", "_at_key").agg(F.collect_list(F.struct("start", "length", "run", "items")).alias("hits"))
    back = rows.join(hits, F.col("_id").eqNullSafe(F.col("_at")) & (F.col("_key") == F.col("_at_key"))).select("*", F.explode("hits").alias("h")).select(*rows.columns, "h.*")
    back = back.where(_run_text(F.col("length")) == F.col("run")).select(*out, F.lit(False).alias("first"), "start", "length", "items")
    return back.unionByName(rows.select(*out, F.lit(True).alias("first"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("length"), F.lit(None).cast("array<string>").alias("items")))


def judge(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20, broadcast_windows: int = BROADCAST_WINDOWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each row of docs; also key, a hash of the text.

    A document is contaminated if at least one of its words is hit and
    share * n_hit >= n_words.
    """
    hits = occurrences(docs, benchmark, n, broadcast_windows=broadcast_windows).groupBy("_id", "_key").agg(
        F.max("n_words").alias("n_words"), F.sum(F.col("first").cast("int")).alias("rows"),
        F.array_sort(F.collect_set(F.when(F.col("length").isNotNull(), F.struct("start", "length")))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    # words covered by the union of the spans, in their order
    covered = F.aggregate(
        "spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("upto")),
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0), s["start"] + s["length"] - F.greatest(a["upto"], s["start"]))).alias("n"), F.greatest(a["upto"], s["start"] + s["length"]).alias("upto")),
        lambda a: a["n"],
    )
    rows = hits.select("_id", "_key", "n_words", covered.cast("long").alias("n_hit"), "items", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    return rows.select(
        F.col("_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.col("n_hit") * share >= F.col("n_words"))).alias("contaminated"), F.col("_key").alias("key"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, share: int = 20) -> DataFrame:
    """docs without the contaminated documents."""
    return without(docs, judge(docs, benchmark, n, share).where("contaminated").select(F.col("doc_id").alias("_id"), F.col("key").alias("_key")))


def remove_spans(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """doc_id and kept_words: the words of each document that no window covers, lower-cased (A-Z)."""
    hits = occurrences(docs, benchmark, n).where("length is not null").groupBy("_id", "_key", "start").agg(F.max("length").alias("length"))
    hits = hits.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("start", "length"))).alias("spans"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("key"), F.transform(words(F.col("text")), _lowered).alias("words"))
    rows = rows.join(hits, rows["doc_id"].eqNullSafe(hits["_id"]) & (rows["key"] == hits["_key"]), "left")
    # the words before each span but for those that earlier spans cover (of the last n: starts are different, lengths up to n), and those after the last
    end = lambda i: F.get("ends", i - 1)
    ends = F.transform("spans", lambda s: s["start"] + s["length"])
    rows = rows.withColumn("ends", F.transform(ends, lambda e, i: F.when(i >= F.lit(n), F.array_max(F.slice(ends, i - n + 1, n + 1))).otherwise(F.array_max(F.slice(ends, F.lit(1), i + 1)))))
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(end(i))
    stop = lambda i: F.coalesce(F.get("spans", i)["start"], F.size("words"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("spans")), lambda i: F.slice("words", begin(i) + 1, F.greatest(F.lit(0), stop(i) - begin(i))))
    return rows.select("doc_id", F.when(F.col("spans").isNull(), F.col("words")).otherwise(F.flatten(pieces)).alias("kept_words"))


ORACLE = """
with dw as (select doc_id, md5(coalesce(text, '')) k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from {documents}),
bw as (select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from benchmark),
bs as (select item_id, w, unnest(range(0, greatest(len(w) - 12, 1))) s from bw where len(w) > 0),
b as (select distinct item_id, w[s + 1 : least(s + 13, len(w))] g from bs),
ls as (select distinct len(g) n from b),
ds as (select doc_id, k, w, n, unnest(range(0, len(w) - n + 1)) s from dw, ls where len(w) >= n),
o as (select doc_id, k, s, n, item_id from (select doc_id, k, s, n, w[s + 1 : s + n] g from ds) x join b using (g)),
h as (select doc_id, k, count(distinct p) n_hit from (select doc_id, k, unnest(range(s, s + n)) p from (select distinct doc_id, k, s, n from o)) group by 1, 2),
i as (select doc_id, k, count(*) n_items, string_agg(item, ',' order by item) items from (select distinct doc_id, k, cast(item_id as varchar) item from o) group by 1, 2)
select d.doc_id, cast(len(w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items, sha256(coalesce(items, '')) items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
from dw d left join h on d.doc_id is not distinct from h.doc_id and d.k = h.k left join i on d.doc_id is not distinct from i.doc_id and d.k = i.k
"""
