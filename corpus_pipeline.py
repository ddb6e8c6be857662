"""A training corpus from the documents table, in five stages.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as
Parquet and read again as the docs of the next one.  All but the last give the
columns that they got; columns of any other name go through unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from circlet.llm import decontaminate, language_id, line_dedup, minhash_dedup, source_mix
from circlet.llm._shared import few, materialise, table

#: a document is rejected if no language is at least so likely
MIN_SCORE = 0.5
#: or if its n-grams are less likely under its language than under equal chances for all
MIN_FIT = 0.0


def _language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any letter, of an unsure language or of none of the learned ones (noise too) go.

    Learned from rows with a language that aren't held out.  Null, empty and blank texts go; so do all rows if
    none has a language.  Texts are judged whole, whatever their length.  Rows of equal texts, with equal or with
    null ids, go or stay together.  An empty table gives an empty one.
    """
    model = language_id.train(docs.where(~language_id.held_out("doc_id")))
    judged = language_id.predict(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "text"), model)
    fine = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("lang_score") >= MIN_SCORE) & (F.col("lang_fit") >= MIN_FIT)
    return judged.where(fine).select("row.*")


def _line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Chunks of lines that stand elsewhere before are cut out of the texts; documents of which nothing is left go.

    n_chars is counted anew.  Null, empty and blank texts stay as they are.  Before means: by doc_id, nulls first, then by
    a hash of the text, then by line.  Rows that are equal in id and text are one document: all of them keep the
    same lines.  An empty table gives an empty one.
    """
    found = line_dedup.dedup(docs, keep_emptied=False)
    return found.select(*[F.length("text").cast(dict(docs.dtypes)[c]).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def _near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more) the document with the smallest id stays.

    Null, empty and blank texts have no copies and stay.  Rows that are equal in id and text are one document and
    stay or go together; of copies with null ids only, those of one text stay.  An empty table gives an empty one.
    """
    return minhash_dedup.dedup(docs, shingle=5, percent=80)


def _decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words is in windows of benchmark items go.

    Null, empty and blank texts have no words and stay; so does all with an empty benchmark.  Rows of equal texts,
    with equal or with null ids, are judged alike.  An empty table gives an empty one.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def _mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus: a row for each time that a document is taken, with all its columns, in the order of training.

    Added are epoch (from 0), words (how many of the text's words this occurrence gives: its first ones) and
    position (in [0, 1]); documents' columns of these names are replaced.  Rows are range-partitioned and sorted by
    position.  A document that isn't taken has no row: so have null and empty texts.  Repeated rows are taken each
    by itself, as are rows with null ids; a null source is the last one.  An empty table gives an empty one.
    """
    new = ("epoch", "words", "position")
    # a row of the table is told by its file and its place there, so that only narrow rows are joined with the texts
    place = {"_file": F.xxhash64("_metadata.file_path"), "_row": F.col("_metadata.row_index")}
    taken = materialise(source_mix.takings(source_mix.mix(docs, carry=place), *place).select(*place, *new), "takings")
    rows = docs.select(*[c.alias(k) for k, c in place.items()], F.struct(*[F.col(f"`{c}`") for c in docs.columns if c not in new]).alias("doc"))
    rows = rows.join(few(taken), ["_file", "_row"]).select("doc", *new)
    order = [F.col("position"), F.col("doc.doc_id").asc_nulls_last()]
    rows = rows.repartitionByRange(64, *order).sortWithinPartitions(*order)
    return rows.select(*[F.col(f"doc.`{c}`") for c in docs.columns if c not in new], *new)


STAGES = [("language_id", _language_id), ("line_dedup", _line_dedup), ("near_dedup", _near_dedup), ("decontaminate", _decontaminate), ("mix", _mix)]

#: naive Bayes and sketches aren't SQL; tests/llm compares the stages with plain versions
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows, over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
