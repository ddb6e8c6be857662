"""Mixing sources to target weights: a time-varying curriculum.

Every source has a schedule, its weight at some times in [0, 1], linear in
between.  At each of those times the weights are shared out to 1; a source's
demand is the integral of its share.  The integral over all of [0, 1] says how
many words the source gives (no more than ``max_epochs`` times what it has;
the excess goes to the other sources by their shares until none is above).
Within a source the documents stand in the order of a digest of their id and
are taken again and again until the demand is met: each taking is an
occurrence.  The point of the schedule at which the demand reaches the middle
of an occurrence is its training position; every occurrence has one.

Without a schedule the weights are tilted over the training by CURRICULUM: at
each time a source's share is its weight's, more or less by a part that depends
on its rank.  At each time these parts cancel out over the sources, and over
[0, 1] they do for each source, so that the integrals are the weights.

All of it is DataFrame operations.  The running sum of words in a source is
made in two steps (by digest prefix, then within a prefix), so that a source
with most of the rows is dealt over as many tasks as any other.

Defined results: a null text has size 0; such a document is taken 0 times.  A
null source is a source of its own, after all others.  Repeated rows count
each.  With an empty table the result is empty.  Reruns give the same rows.
More than MAX_SOURCES sources are refused.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._shared import materialise

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MAX_EPOCHS = 2.0
#: times and tilts, linear in between, with the integral 0: sources of low rank stand earlier
CURRICULUM = ((0.0, -0.8), (0.25, -0.8), (0.75, 0.8), (1.0, 0.8))
#: one row for each source is sorted by one task and broadcast (about 100 bytes)
MAX_SOURCES = 1_000_000
#: hexadecimal digits of the digest that deal a source's rows; 4096 runs a source
PREFIX = 3


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", carry: dict[str, Column] | None = None) -> DataFrame:
    """doc_id, source, size and digest of each row, and what else is carried; a scan of the whole texts that is written out once."""
    rows = docs.select(
        *[c.alias(name) for name, c in (carry or {}).items()],
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"),
        F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")).alias("digest"),
    )
    return materialise(rows, "mix-sizes")


def _schedules(sources: DataFrame, weights: tuple[float, ...], schedule: list[tuple[float, tuple[float, ...]]] | None) -> tuple[DataFrame, list[float]]:
    """sources with w0.. (the share of all weights at each time) and share (the integral)."""
    knots = schedule or [(t, weights) for t, _ in CURRICULUM]
    times = [t for t, _ in knots]
    if times != sorted(set(times)) or times[0] != 0 or times[-1] != 1:
        raise ValueError("times of a schedule begin at 0, end at 1 and grow")
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    out = sources.withColumn("rank", rank)
    for k, (_, row) in enumerate(knots):
        out = out.withColumn(f"w{k}", F.element_at(F.array(*[F.lit(float(w)) for w in row]), (F.pmod("rank", F.lit(len(row))) + 1).cast("int")))
    if schedule:
        all_rows = Window.partitionBy()
        for k in range(len(knots)):
            out = out.withColumn(f"w{k}", F.col(f"w{k}") / F.sum(f"w{k}").over(all_rows))
        share = sum(((F.col(f"w{k}") + F.col(f"w{k + 1}")) * F.lit((times[k + 1] - times[k]) / 2) for k in range(len(knots) - 1)), F.lit(0.0))
    else:
        share = F.col("weight")
        lead = F.pmod("rank", F.lit(len(weights))) / F.lit(max(len(weights) - 1, 1))
        out = out.withColumn("weight", F.col("w0")).withColumn("lead", lead)
        out = out.withColumn("lead", F.col("lead") - F.sum(F.col("weight") * F.col("lead")).over(Window.partitionBy()) / F.sum("weight").over(Window.partitionBy()))
        for k, (_, tilt) in enumerate(CURRICULUM):
            out = out.withColumn(f"w{k}", F.col("weight") * (1 + F.lit(tilt) * F.col("lead")))
    return out.withColumn("share", share), times


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, schedule: list[tuple[float, tuple[float, ...]]] | None = None) -> tuple[DataFrame, list[float]]:
    """A row for each source: source_size, target and its schedule.

    Sources that reach the limit are the first ones by limit per share; what
    is left over is shared by the rest.  One row per source is sorted here, by
    few tasks: the number of sources doesn't grow with the documents.
    """
    per = materialise(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-sources")
    if (n := per.count()) > MAX_SOURCES:
        raise ValueError(f"{n} sources; at most {MAX_SOURCES} can be mixed")
    per, times = _schedules(per, weights, schedule)
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(max_epochs)))
    by = Window.orderBy(F.col("limit") / F.col("share"), "rank")
    before, everything = by.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    budget = F.sum("source_size").over(everything) * F.lit(float(total_share))
    per = (
        per.withColumn("left", budget - F.coalesce(F.sum("limit").over(before), F.lit(0.0)))
        .withColumn("rest", F.sum("share").over(everything) - F.coalesce(F.sum("share").over(before), F.lit(0.0)))
        .withColumn("level", F.col("left") / F.col("rest"))
        .withColumn("full", F.col("limit") <= F.col("level") * F.col("share"))
        .withColumn("free_level", F.min(F.when(~F.col("full"), F.struct("rank", "level"))).over(everything))
    )
    # all sources that aren't full have the level of the first of them in the order
    first = Window.orderBy(F.when(F.col("full"), 1).otherwise(0), F.col("limit") / F.col("share"), "rank")
    per = per.withColumn("level", F.first("level").over(first))
    per = per.withColumn("target", F.when(F.col("full"), F.col("limit")).otherwise(F.col("level") * F.col("share")))
    return per.drop("left", "rest", "full", "free_level", "limit"), times


def _place(at: Column, times: list[float]) -> Column:
    """The time at which a source's demand, as a part of its target, is ``at``."""
    if len(times) == 2:
        steps = [(0, F.lit(0.0))]
    else:
        steps, done = [], F.lit(0.0)
        for k in range(len(times) - 1):
            steps.append((k, done))
            done = done + (F.col(f"w{k}") + F.col(f"w{k + 1}")) * F.lit((times[k + 1] - times[k]) / 2) / F.col("share")
    out = None
    for k, done in steps:
        h = times[k + 1] - times[k]
        a, b = F.col(f"w{k}") / F.col("share"), F.col(f"w{k + 1}") / F.col("share")
        if len(steps) == 1:
            a, b = F.col("w0") / (F.col("w0") + F.col("w1")) * 2, F.col("w1") / (F.col("w0") + F.col("w1")) * 2
        c = at - done
        root = F.sqrt(F.greatest(a * a + 2 * (b - a) * c / F.lit(h), F.lit(0.0)))
        here = F.lit(times[k]) + F.least(F.when(a + root > 0, 2 * c / (a + root)).otherwise(F.lit(0.0)), F.lit(h))
        out = here if out is None else F.when(c > 0, here).otherwise(out)
    return out


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, total_share: float = TOTAL_SHARE, max_epochs: float = MAX_EPOCHS, schedule: list[tuple[float, tuple[float, ...]]] | None = None, carry: dict[str, Column] | None = None) -> DataFrame:
    """A row for each document: doc_id, size, source_size, target, taken, source, n_epochs, position (of its first occurrence; null if it isn't taken), positions (of each occurrence), and what is carried: columns of docs by their new names."""
    sized = sizes(docs, carry=carry)
    per, times = targets(sized, weights, total_share, max_epochs, schedule)
    prefix = F.substring("digest", 1, PREFIX)
    runs = sized.groupBy("source", prefix.alias("prefix")).agg(F.sum("size").alias("run"))
    runs = runs.withColumn("run_before", F.coalesce(F.sum("run").over(Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("run")
    runs = runs.join(F.broadcast(per), runs["source"].eqNullSafe(per["source"])).drop(per["source"])
    within = Window.partitionBy("source", "prefix").orderBy("digest", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = sized.withColumn("prefix", prefix).withColumn("in_run", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(runs, rows["source"].eqNullSafe(runs["source"]) & (rows["prefix"] == runs["prefix"]), "left").drop(runs["source"]).drop(runs["prefix"])
    before = F.col("run_before") + F.col("in_run")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rest = F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long")
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("before")))
    rows = rows.withColumn("before", before).withColumn("whole", whole).withColumn("rest", rest).withColumn("part", part)
    taken = F.col("whole") * F.col("size") + F.col("part")
    n_epochs = F.when(taken > 0, F.col("whole") + F.when(F.col("part") > 0, 1).otherwise(0)).otherwise(0)
    middle = lambda j: (j * F.col("source_size") + F.col("before") + F.when(j < F.col("whole"), F.col("size")).otherwise(F.col("part")) / 2) / F.col("target")
    positions = F.when(taken > 0, F.transform(F.sequence(F.lit(0).cast("long"), n_epochs - 1), lambda j: _place(middle(j), times))).otherwise(F.array().cast("array<double>"))
    return rows.select(
        "doc_id", "size", "source_size", "target", taken.alias("taken"), "source",
        n_epochs.alias("n_epochs"), positions.alias("positions"), "whole", "part", *(carry or {}),
    ).select("doc_id", "size", "source_size", "target", "taken", "source", "n_epochs", F.get("positions", F.lit(0)).alias("position"), "positions", "whole", "part", *(carry or {}))


def training_order(mixed: DataFrame, partitions: int = 64) -> DataFrame:
    """The documents in the order of training: range-partitioned and sorted by position; those that aren't taken come last."""
    order = [F.col("position").asc_nulls_last(), F.col("doc_id").asc_nulls_last()]
    return mixed.repartitionByRange(partitions, *order).sortWithinPartitions(*order)


def report(docs: DataFrame) -> DataFrame:
    """What each document gives and where in training it stands, sorted by that; positions are rounded to nine digits."""
    at = lambda j: F.round(F.get("positions", j), 9)
    rows = training_order(mix(docs))
    return rows.select("doc_id", "size", "source_size", "target", "taken", "n_epochs", at(F.lit(0)).alias("first_position"), at(F.col("n_epochs").cast("int") - 1).alias("last_position"))


def takings(mixed: DataFrame, *carried: str) -> DataFrame:
    """doc_id, source, epoch (from 0), words and position of each occurrence, and columns that were carried; no row for what isn't taken."""
    rows = mixed.select("doc_id", "source", "size", "whole", "part", *carried, F.posexplode("positions").alias("epoch", "position"))
    return rows.select("doc_id", "source", *carried, "epoch", F.when(F.col("epoch") < F.col("whole"), F.col("size")).otherwise(F.col("part")).alias("words"), "position")


ORACLE = """
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) size, md5(coalesce(cast(doc_id as varchar), '')) digest from {documents}),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 rank from d group by source),
w as (select *, case rank % 3 when 0 then 5.0::double when 1 then 2.0::double else 1.0::double end w, source_size * 2.0::double lim from s),
l as (select *, (sum(source_size) over () * 1.5::double - coalesce(sum(lim) over (order by lim / w, rank rows between unbounded preceding and 1 preceding), 0.0::double))
  / (sum(w) over () - coalesce(sum(w) over (order by lim / w, rank rows between unbounded preceding and 1 preceding), 0.0::double)) as lev from w),
f as (select *, lim <= lev * w as is_full from l),
t as (select source, source_size, case when is_full then lim else first_value(lev) over (order by case when is_full then 1 else 0 end, lim / w, rank) * w end target,
  rank % 3 / 2.0::double - sum(w * (rank % 3 / 2.0::double)) over () / sum(w) over () as head_start from f),
r as (select d.doc_id, d.size, t.source_size, t.target, t.head_start, cast(coalesce(sum(d.size) over (partition by d.source order by digest, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) before,
  case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end whole
  from d join t on d.source is not distinct from t.source),
p as (select *, greatest(0, least(size, cast(round(target - whole * source_size) as bigint) - before)) part from r),
n as (select *, cast(whole * size + part as bigint) taken, cast(case when whole * size + part = 0 then 0 when part > 0 then whole + 1 else whole end as bigint) n_epochs from p),
-- the part of the target before the middle of the first and of the last taking; the shares at the ends and where the middle and the last stretch begin
m as (select *, 1 - 0.8::double * head_start a, 1 + 0.8::double * head_start b, (before + case when whole > 0 then size else part end / 2.0::double) / target f1,
  ((n_epochs - 1) * source_size + before + case when n_epochs - 1 < whole then size else part end / 2.0::double) / target f2 from n),
q as (select *, [f1, f2] fs from m),
o as (select *, list_transform(fs, lambda f: case when f <= 0.25::double * a then f / a when f > 0.25::double * a + 0.5::double then 0.75::double + (f - 0.25::double * a - 0.5::double) / b
  else 0.25::double + 2 * (f - 0.25::double * a) / (a + sqrt(greatest(0, a * a + 4 * (b - a) * (f - 0.25::double * a)))) end) ts from q)
select doc_id, size, source_size, target, taken, n_epochs, case when taken > 0 then round(least(ts[1], 1), 9) end first_position, case when taken > 0 then round(least(ts[2], 1), 9) end last_position from o
"""
