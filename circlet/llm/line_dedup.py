"""Line dedup with content-defined chunks of lines.

A text's lines are hashed, and a rolling hash over the last WINDOW line hashes
chooses the places where a chunk of WINDOW lines is taken: where it is 0 modulo
DIVISOR.  As it depends on the lines only, the same passage gives the same
chunks wherever it stands.  DIVISOR is 1: with sparser boundaries a passage of a
few lines mostly has none of its own.  Chunks that stand in several places are
found by their hashes and compared byte by byte (they are grouped by the chunk
itself).  Neighbouring chunks that stand elsewhere before make up a run, which
so is as long as the repetition; runs of MIN_LINES lines or more that aren't
blank are removed, so that of each repeated passage the first place (by doc_id,
then by line) stays.

All of it is DataFrame operations, and texts stay in their rows until a chunk
is known to share its hash with another: repeated hashes are broadcast up to
BROADCAST_IDS, beyond it places without text are joined with them.  A hash with more than 1/HOT_PARTS of
all repeated chunks is hot: there are fewer than HOT_PARTS of them, so they can
be broadcast, and their rows are dealt over SALTS tasks in both joins.

Defined results: a null text stays null and has 0 lines, an empty one has one
empty line.  A line is blank if it has no other characters than ASCII
whitespace; runs with fewer than MIN_LINES others stay.  Null ids come first,
equal ids are ordered by a hash of the text.  Rows that are equal in doc_id and
text count as one document and are cut alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import BROADCAST_IDS, materialise

WINDOW = 2
DIVISOR = 1
MIN_LINES = 2
#: fewer hashes than this can be hot, whatever the input
HOT_PARTS = 1000
SALTS = 64


def _line_hash(line: Column) -> Column:
    return F.conv(F.substring(F.md5(line.cast("binary")), 1, 7), 16, 10).cast("long")


def _lines(docs: DataFrame) -> DataFrame:
    return docs.where(F.col("text").isNotNull()).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_key"), F.split("text", "\n").alias("lines"))


def _chunk(start: Column) -> Column:
    return F.concat_ws("\n", *[F.get("lines", start + k) for k in range(WINDOW)])


def chunks(docs: DataFrame, divisor: int = DIVISOR) -> DataFrame:
    """_id, _key (a hash of the text), start (line number, from 0) and chunk of each chunk."""
    rows = _lines(docs)
    # explode_outer: for explode, the optimizer would infer a filter that splits the text once more
    if divisor == 1:
        starts = F.when(F.size("lines") >= WINDOW, F.sequence(F.lit(0), F.size("lines") - WINDOW))
    else:
        rows = rows.select("*", F.transform("lines", _line_hash).alias("hashes"))
        rolling = lambda i: F.get("hashes", i) * 31 + F.get("hashes", i + 1)
        starts = F.filter(F.when(F.size("lines") >= WINDOW, F.sequence(F.lit(0), F.size("lines") - WINDOW)), lambda i: F.pmod(rolling(i), F.lit(divisor)) == 0)
    rows = rows.select("_id", "_key", "lines", F.explode_outer(starts).alias("start")).where("start is not null")
    return rows.select("_id", "_key", "start", _chunk(F.col("start")).alias("chunk"))


def _shared(docs: DataFrame, one: DataFrame, often: DataFrame, divisor: int, broadcast_hashes: int) -> DataFrame:
    """The chunks (one) whose hashes are in often (hash, hot, salt), with their texts."""
    if often.limit(broadcast_hashes + 1).count() <= broadcast_hashes:
        return one.join(F.broadcast(often), ["hash", "salt"])
    # places only are joined by a shuffle; then the documents that have any are cut again
    hits = one.drop("chunk").join(often, ["hash", "salt"]).groupBy("_id", "_key").agg(F.collect_set(F.struct("start", "hot", "salt")).alias("hits"))
    rows = _lines(docs).withColumnsRenamed({"_id": "_at", "_key": "_at_key"})
    back = rows.join(hits, F.col("_at").eqNullSafe(F.col("_id")) & (F.col("_at_key") == F.col("_key"))).select("_id", "_key", "lines", F.explode("hits").alias("h"))
    return back.select("_id", "_key", "h.start", _chunk(F.col("h.start")).alias("chunk"), "h.hot", "h.salt")


def repeated(docs: DataFrame, divisor: int = DIVISOR, broadcast_hashes: int = BROADCAST_IDS) -> DataFrame:
    """_id, _key, runs: start and end (line numbers, both inside), ascending, of the runs of chunks that stand elsewhere before."""
    one = chunks(docs, divisor).withColumn("hash", F.xxhash64("chunk"))
    often = materialise(one.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"), "line-hashes")
    total = often.agg(F.sum("n")).first()[0] or 0
    hot = often.where(F.col("n") * HOT_PARTS > total).select("hash", F.lit(True).alias("hot"))
    salts = F.explode(F.when(F.col("hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))).alias("salt")
    often = often.select("hash", (F.col("n") * HOT_PARTS > total).alias("hot")).select("hash", salts)
    dealt = F.when(F.col("hot"), F.pmod(F.xxhash64("_id", "_key", "start"), F.lit(SALTS)).cast("int")).otherwise(F.lit(0))
    one = one.join(F.broadcast(hot), "hash", "left").withColumn("hot", F.coalesce("hot", F.lit(False))).withColumn("salt", dealt)
    places = materialise(_shared(docs, one, often, divisor, broadcast_hashes).select("_id", "_key", "start", "chunk", "hot", "salt"), "line-chunks")
    order = F.struct(F.col("_id").isNotNull(), "_id", "_key", "start")
    first = places.groupBy("hot", "chunk").agg(F.min(order).alias("first"), F.count("*").alias("n")).where("n > 1").select("chunk", "first", salts)
    later = places.join(first, ["chunk", "salt"]).where(order > F.col("first")).select("_id", "_key", "start").distinct()
    by = Window.partitionBy("_id", "_key").orderBy("start")
    begins = F.coalesce((F.col("start") > F.lag("start").over(by) + WINDOW).cast("int"), F.lit(1))
    runs = later.withColumn("begins", begins).withColumn("run", F.sum("begins").over(by))
    runs = runs.groupBy("_id", "_key", "run").agg(F.min("start").alias("start"), (F.max("start") + WINDOW - 1).alias("end"))
    return runs.groupBy("_id", "_key").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("runs"))


def _cut(docs: DataFrame, divisor: int, min_lines: int) -> DataFrame:
    """row (the columns of docs), lines, runs (what is removed; null: nothing) and text (what is left) of each row."""
    found = repeated(docs, divisor)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    joined = rows.join(found, F.col("row.doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("row.text") == F.col("_key")), "left").select("row", "runs")
    joined = joined.withColumn("lines", F.split("row.text", "\n"))
    written = lambda r: F.size(F.filter(F.slice("lines", r["start"] + 1, r["end"] - r["start"] + 1), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    joined = joined.withColumn("runs", F.filter("runs", lambda r: written(r) >= min_lines))
    # the lines before each run, and those after the last
    begin = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get("runs", i - 1)["end"] + 1)
    end = lambda i: F.coalesce(F.get("runs", i)["start"], F.size("lines"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("runs")), lambda i: F.slice("lines", begin(i) + 1, end(i) - begin(i)))
    text = F.when(F.coalesce(F.size("runs"), F.lit(0)) <= 0, F.col("row.text")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return joined.select("row", "lines", "runs", text.alias("text"))


def dedup(docs: DataFrame, divisor: int = DIVISOR, min_lines: int = MIN_LINES, keep_emptied: bool = True) -> DataFrame:
    """docs with the text that is left; on demand without the documents of which runs were removed and only blank lines are left."""
    rows = _cut(docs, divisor, min_lines)
    if not keep_emptied:
        rows = rows.where((F.coalesce(F.size("runs"), F.lit(0)) <= 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`") for c in docs.columns])


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_removed (lines), n_chunks (runs removed) and kept_md5 of each row."""
    rows = _cut(docs.select("doc_id", "text"), DIVISOR, MIN_LINES)
    gone = F.aggregate(F.coalesce("runs", F.array().cast("array<struct<start:int,end:int>>")), F.lit(0), lambda a, s: a + s["end"] - s["start"] + 1)
    count = lambda c: F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)).cast("long")
    return rows.select("row.doc_id", count("lines").alias("n_lines"), gone.cast("long").alias("n_removed"), count("runs").alias("n_chunks"), F.md5(F.col("text").cast("binary")).alias("kept_md5"))


ORACLE = """
with d as (select distinct doc_id, md5(text) k, string_split(text, chr(10)) ls from {documents} where text is not null),
c as (select doc_id, k, ls, unnest(range(1, len(ls))) s from d),
r as (select doc_id, k, s, row_number() over (partition by ls[s] || chr(10) || ls[s + 1] order by doc_id nulls first, k, s) n from c),
b as (select doc_id, k, s, case when s <= lag(s) over (partition by doc_id, k order by s) + 2 then 0 else 1 end begins from r where n > 1),
g as (select doc_id, k, s, sum(begins) over (partition by doc_id, k order by s) run from b),
u as (select doc_id, k, run, min(s) a, max(s) + 1 z from g group by 1, 2, 3),
w as (select u.* from u join d on u.doc_id is not distinct from d.doc_id and u.k = d.k where len(list_filter(ls[a:z], lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]'))) >= 2),
m as (select doc_id, k, sum(z - a + 1) n_removed, count(*) n_chunks, flatten(list(range(a, z + 1))) gone from w group by 1, 2)
select x.doc_id, cast(coalesce(len(string_split(x.text, chr(10))), 0) as bigint) n_lines, cast(coalesce(n_removed, 0) as bigint) n_removed, cast(coalesce(n_chunks, 0) as bigint) n_chunks,
  md5(case when gone is null then x.text else array_to_string(list_transform(list_filter(range(1, len(string_split(x.text, chr(10))) + 1), lambda i: not list_contains(gone, i)), lambda i: string_split(x.text, chr(10))[i]), chr(10)) end) kept_md5
from {documents} x left join m on x.doc_id is not distinct from m.doc_id and md5(x.text) = m.k
"""
