"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts (language, bin) pairs with a Spark aggregation; the
log-probability matrix (bins x languages, a fixed size for a given label set)
is broadcast, and texts are scored in numpy, a block of texts at a time.  An
n-gram is of Unicode characters, lower-cased, with spaces for all ASCII
characters but letters.

Beside the posterior, which is near 1 for any longer text, a text gets its
fit: the mean log-probability of its n-grams under its language, more or less
than under equal chances for all bins.  Text of no learned language has a
negative fit.

Defined results: a null text, an empty text and one without any letter (Unicode
category L) is ``und`` with score 0 and a null fit.  Without labelled rows every
text is ``und``.  Of equally likely languages the first by name is given.  A row
with a null id is never held out.  Repeated rows get the same answer each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


BINS = 1 << 15
#: n-gram lengths, in characters
ORDERS = (2, 3)
#: training uses every labelled row up to this many; beyond it a hash-selected share of that size
TRAIN_ROWS = 2_000_000
UNKNOWN = "und"
_BLOCK = 1 << 20
_WORDLIKE = re.compile(r"[^\W\d_]")
#: lower-cased; every ASCII character but letters becomes a space
_ASCII = np.array([c if 97 <= c <= 122 else 32 for c in range(128)], np.uint32)


def has_letter(text: str | None) -> bool:
    """Whether a character of a Unicode category L is there."""
    return text is not None and any(m.group().isalpha() for m in _WORDLIKE.finditer(text))


def _blocks(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, characters, start of each text) for runs of texts of about _BLOCK characters."""
    first, parts, size = 0, [], 0
    for i, text in enumerate(texts):
        part = f" {text.lower()} "
        parts.append(part)
        size += len(part)
        if size >= _BLOCK or i == len(texts) - 1:
            starts = np.cumsum([0] + [len(p) for p in parts[:-1]])
            data = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
            yield first, np.where(data < 128, _ASCII[data & 127], data), starts
            first, parts, size = i + 1, [], 0


def _bins(data: np.ndarray, starts: np.ndarray, order: int) -> np.ndarray:
    """The bin of the n-gram that begins at each character; BINS where it would leave its text."""
    n = len(data)
    value = np.zeros(n, np.uint32)
    for k in range(order):
        value[: n - k] = value[: n - k] * np.uint32(2654435761) + data[k:]
    value *= np.uint32(2246822519)
    value ^= value >> np.uint32(15)
    value += np.uint32(order * 40503)
    out = (value & np.uint32(BINS - 1)).astype(np.int32)
    ends = np.append(starts[1:], n)
    for k in range(1, order):
        out[np.maximum(ends - k, starts)] = BINS
    return out


def _count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """lang, bin, n of a partition; bin -1 holds the number of texts."""
    totals: dict[str, np.ndarray] = {}
    rows: dict[str, int] = {}
    for batch in batches:
        for lang, part in batch.groupby("lang"):
            total = totals.setdefault(lang, np.zeros(BINS + 1, np.int64))
            texts = [t for t in part["text"] if has_letter(t)]
            rows[lang] = rows.get(lang, 0) + len(texts)
            for _, data, starts in _blocks(texts):
                for order in ORDERS:
                    total += np.bincount(_bins(data, starts, order), minlength=BINS + 1)
    for lang, total in totals.items():
        (used,) = np.nonzero(total[:BINS])
        yield pd.DataFrame({"lang": lang, "bin": np.append(used, -1), "n": np.append(total[used], rows[lang])})


def train(labelled: DataFrame, text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS, smoothing: float = 0.5) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, the matrix (BINS + 1, languages; its last row is 0) and the log priors."""
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where("lang is not null and text is not null")
    there = rows.select("lang").count()
    if there > train_rows:
        rows = rows.where(F.pmod(F.xxhash64("text"), F.lit(1 << 30)) < int(train_rows / there * (1 << 30)))
    counts = rows.mapInPandas(_count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts.loc[(counts["bin"] == -1) & (counts["n"] > 0), "lang"])
    matrix = np.zeros((BINS + 1, len(langs)), np.float64)
    prior = np.zeros(len(langs))
    for k, name in enumerate(langs):
        own = counts[counts["lang"] == name]
        held = own[own["bin"] >= 0]
        prior[k] = own.loc[own["bin"] == -1, "n"].sum()
        matrix[held["bin"].to_numpy(), k] = held["n"].to_numpy()
    if langs:
        matrix[:BINS] += smoothing
        matrix[:BINS] = np.log(matrix[:BINS] / matrix[:BINS].sum(axis=0))
        matrix[BINS] = 0
        prior = np.log(prior / prior.sum())
    return langs, matrix.astype(np.float32), prior


def score_texts(texts: list[str | None], langs: list[str], matrix: np.ndarray, prior: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Best language, its posterior and the fit (NaN: none) for each text."""
    best, score, fit = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan)
    real = [i for i, t in enumerate(texts) if langs and has_letter(t)]
    for first, data, starts in _blocks([texts[i] for i in real]):
        total, n = np.zeros((len(starts), len(langs))), np.zeros(len(starts))
        for order in ORDERS:
            at = _bins(data, starts, order)
            n += np.add.reduceat(at < BINS, starts, dtype=np.int64)
            for k in range(len(langs)):
                total[:, k] += np.add.reduceat(matrix[:, k][at], starts, dtype=np.float64)
        here = np.array(real[first : first + len(starts)])
        top = (total + prior).argmax(axis=1)
        fit[here] = total[np.arange(len(top)), top] / n + np.log(BINS)
        total += prior
        share = 1 / np.exp(np.minimum(total - total.max(axis=1, keepdims=True), 0)).sum(axis=1)
        score[here] = np.clip(share, 0, 1)
        for i, t in zip(here, top, strict=True):
            best[i] = langs[t]
    return best, score, fit


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, np.ndarray], text: str = "text") -> DataFrame:
    """docs with the columns lang_pred, lang_score and lang_fit; columns of these names are replaced."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, lang_score double, lang_fit double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        langs, matrix, prior = held.value
        matrix = np.asfortranarray(matrix)
        for batch in batches:
            best, score, fit = score_texts(list(batch), langs, matrix, prior)
            yield pd.DataFrame({"lang_pred": best, "lang_score": score, "lang_fit": pd.array(fit, "Float64")})

    new = ("lang_pred", "lang_score", "lang_fit")
    found = judge(F.col(text))
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (*new, "_judged")]
    return docs.select(*kept, found.alias("_judged")).select(*kept, *[f"_judged.{c}" for c in new])


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Trains on the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out("doc_id")))
    rows = docs.select("doc_id", "text", held_out("doc_id").alias("held_out"))
    return predict(rows, model).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
