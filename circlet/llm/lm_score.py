"""Language-model scoring by cross-entropy difference.

Two interpolated bigram models, of the target (rows known to be good) and of
the background (all rows), share one vocabulary: all words of the background,
by 64-bit hashes.  A document's score is the mean over its words of loss under
the target less loss under the background, in nats: the lower, the more it is
like the target.  A training document is scored by the counts of the others:
its own are left out of both models.

Texts are read and cut into words once, into blocks of about ``block_words``
words (a written table: each block's different words and, for each word of its
texts, the place among them).  A block then asks for the counts of its different
words and bigrams: its keys are dealt over buckets of the hash and carry the
block's own counts, a bucket adds up those of all blocks and answers each block
in the order of its keys.  So the counts are exact and grow with the input, a
key stands once in a block's request however frequent it is (no key is hot),
and neither texts nor (document, bigram) rows are joined with counts.  Only
totals reach the driver.

Defined results: a null text or one without words has n_words 0 and null losses
and score.  Without target rows the target's model is the smoothing alone.
Repeated rows count each, and each leaves out itself only.  Rows with a null id
are background.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import discard, few, groups, materialise

MIXED = 0.7
SMOOTHING = 0.1
#: words of a block, about; a block is held in memory by one task (some 150 bytes a word)
BLOCK_WORDS = 1 << 20
#: buckets of keys, at least; so many more that a bucket gets BUCKET_WORDS words of text at most on average
BUCKETS = 512
BUCKET_WORDS = 1 << 23
_START = 0
_CACHE = 500_000
WORDS = ("word_background", "word_target", "history_background", "history_target")


class _Numbers(dict):
    """Word to number, a 64-bit hash; forgets all when it has grown large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _CACHE:
            self.clear()
        n = xxhash.xxh64_intdigest(word)
        self[word] = n = (n - (1 << 64) if n >> 63 else n) or 1
        return n


def word_numbers(text: str | None, known: dict) -> np.ndarray:
    """The numbers of a text's words, after that of its start."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    out = np.empty(len(words) + 1, np.int64)
    out[0] = _START
    out[1:] = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    return out


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of numbers."""
    x = first * np.uint64(0x9E3779B97F4A7C15) + (second ^ (second >> np.uint64(32))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(29))


def _bucket(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Ascending in the keys."""
    return ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)


def _planes(x: np.ndarray) -> bytes:
    """The bytes of integers, all lowest ones first: high ones are mostly 0 and shrink when stored."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).ravel()


def _keys_out(keys: np.ndarray) -> bytes:
    """Of ascending keys, as steps."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _keys_in(data: bytes) -> np.ndarray:
    return np.cumsum(_unplanes(data, np.uint64), dtype=np.uint64)


def _counts_out(*counts: np.ndarray) -> bytes:
    """Columns of counts, in as few bytes each as the largest needs; the first byte says how many."""
    x = np.stack(counts)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.int64) if not x.size or x.max() <= np.iinfo(k).max)
    return bytes([np.dtype(kind).itemsize]) + x.astype(kind).tobytes()


def _counts_in(data: bytes, columns: int) -> np.ndarray:
    kind = {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[data[0]]
    return np.frombuffer(data, kind, offset=1).reshape(columns, -1).astype(np.int64)


class Block:
    """Texts as places in the block's ascending vocabulary, which begins with the start's 0."""

    SCHEMA = "block string, ids array<string>, lengths binary, own binary, vocabulary binary, tokens binary, n long"

    def __init__(self, row):
        self.vocabulary = _keys_in(row["vocabulary"])
        self.tokens = _unplanes(row["tokens"], np.int32)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.own = np.frombuffer(row["own"], np.bool_)
        starts = np.cumsum(self.lengths) - self.lengths
        self.first = np.empty_like(self.tokens)
        self.first[1:] = self.tokens[:-1]
        self.first[starts[self.lengths > 0]] = 0
        self.doc = np.repeat(np.arange(len(self.lengths), dtype=np.int32), self.lengths)
        #: different bigrams, ascending, and for each word that of which it is the second
        self.pairs, self.pair = np.unique(pair_keys(self.vocabulary[self.first], self.vocabulary[self.tokens]), return_inverse=True)

    @staticmethod
    def row(ids: list, own: list, texts: list[np.ndarray]) -> dict:
        words = np.concatenate([t[1:] for t in texts]).view(np.uint64)
        vocabulary, tokens = np.unique(np.append(words, np.uint64(_START)), return_inverse=True)
        lengths = np.array([len(t) - 1 for t in texts], np.int64)
        tokens = tokens[:-1].astype(np.int32)
        return {"block": uuid.uuid4().hex, "ids": ids, "lengths": lengths.tobytes(), "own": np.array(own, np.bool_).tobytes(), "vocabulary": _keys_out(vocabulary), "tokens": _planes(tokens), "n": len(tokens)}

    def word_counts(self) -> tuple[np.ndarray, ...]:
        """Of each word of the vocabulary, as in WORDS."""
        size, own = len(self.vocabulary), self.own[self.doc]
        return tuple(np.bincount(x, minlength=size) for x in (self.tokens, self.tokens[own], self.first, self.first[own]))

    def pair_counts(self) -> tuple[np.ndarray, ...]:
        """Of each bigram, in the background and the target."""
        return tuple(np.bincount(x, minlength=len(self.pairs)) for x in (self.pair, self.pair[self.own[self.doc]]))


def _cut(block_words: int, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known = _Numbers()
    ids, own, texts, held = [], [], [], 0
    for batch in batches:
        for doc_id, mine, text in zip(batch["id"], batch["own"], batch["text"], strict=True):
            texts.append(word_numbers(text, known))
            ids.append(doc_id)
            own.append(mine)
            held += len(texts[-1])
            if held >= block_words:
                yield pd.DataFrame([Block.row(ids, own, texts)])
                ids, own, texts, held = [], [], [], 0
    if texts:
        yield pd.DataFrame([Block.row(ids, own, texts)])


def cut(rows: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The blocks of rows (id, own, text), a written table."""
    found = rows.select(F.col("id").cast("string").alias("id"), "own", "text").mapInPandas(lambda b: _cut(block_words, b), Block.SCHEMA)
    # rows are large: their size is looked at after each, not after a hundred
    return materialise(found, "lm-blocks", {"parquet.block.size.row.check.min": "1", "parquet.block.size.row.check.max": "1", "parquet.block.size": str(64 << 20)})


def _requests(buckets: int, counts: bool, asks: bool, batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What a block has (if it counts) and asks for: a row for each bucket."""
    for batch in batches:
        for _, row in batch.iterrows():
            block = Block(row)
            nothing = lambda keys, n: [np.zeros(len(keys), np.int64)] * n
            words = block.word_counts() if counts else nothing(block.vocabulary, 4)
            pairs = block.pair_counts() if counts else nothing(block.pairs, 2)
            of = np.arange(buckets + 1)
            word_at = np.searchsorted(_bucket(block.vocabulary, buckets), of)
            pair_at = np.searchsorted(_bucket(block.pairs, buckets), of)
            out = []
            for k in range(buckets):
                w, p = slice(word_at[k], word_at[k + 1]), slice(pair_at[k], pair_at[k + 1])
                if w.start < w.stop or p.start < p.stop:
                    out.append((k, row["block"], asks, _keys_out(block.vocabulary[w]), _counts_out(*[x[w] for x in words]), _keys_out(block.pairs[p]), _counts_out(*[x[p] for x in pairs])))
            yield pd.DataFrame(out, columns=["bucket", "block", "asks", "words", "word_counts", "pairs", "pair_counts"])


_REQUEST = "bucket int, block string, asks boolean, words binary, word_counts binary, pairs binary, pair_counts binary"
_ANSWER = "bucket int, block string, word_counts binary, pair_counts binary, n_words long, background long, target long"


def _answers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The sums of a bucket's counts over all blocks, for each block that asks; and a row without a block with the bucket's totals."""
    for frame in groups(batches, ["bucket"]):
        answers: dict[str, list] = {"word_counts": [], "pair_counts": []}
        totals = np.zeros(3, np.int64)
        for keys_of, counts_of, columns in (("words", "word_counts", 4), ("pairs", "pair_counts", 2)):
            keys = [_keys_in(x) for x in frame[keys_of]]
            ends = np.cumsum([len(x) for x in keys])
            different, at = np.unique(np.concatenate(keys), return_inverse=True)
            counts = np.concatenate([_counts_in(x, columns) for x in frame[counts_of]], axis=1)
            # exact in doubles: sums are below 2**53
            sums = [np.bincount(at, weights=c, minlength=len(different)).astype(np.int64) for c in counts]
            if columns == 4:
                totals[:] = (sums[0] > 0).sum(), sums[0].sum(), sums[1].sum()
            for lo, hi, asks in zip(np.append(0, ends[:-1]), ends, frame["asks"], strict=True):
                answers[counts_of].append(_counts_out(*[s[at[lo:hi]] for s in sums]) if asks else None)
        asks = frame["asks"].to_numpy(bool)
        out = frame.loc[asks, ["bucket", "block"]].assign(**{k: [x for x in v if x is not None] for k, v in answers.items()}, n_words=0, background=0, target=0)
        yield out
        yield pd.DataFrame([(frame["bucket"].iloc[0], None, None, None, *totals)], columns=out.columns)


def _losses(block: Block, words: np.ndarray, pairs: np.ndarray, totals: dict[str, int], vocabulary: int, leave_out: bool) -> dict[str, np.ndarray]:
    """The sum of losses over each document's words, for both sides."""
    docs, size = len(block.lengths), len(block.vocabulary)
    code, at, n = np.unique(block.doc.astype(np.int64) * max(len(block.pairs), 1) + block.pair, return_index=True, return_counts=True)
    doc, pair, first, second = block.doc[at], block.pair[at], block.first[at], block.tokens[at]

    def own(places: np.ndarray) -> np.ndarray:
        """How often the word stands in the document, for each of its different bigrams."""
        _, where, counts = np.unique(block.doc.astype(np.int64) * size + places, return_inverse=True, return_counts=True)
        return counts[where[at]]

    own_first, own_second = own(block.first), own(block.tokens)
    out = {}
    for k, side in ((1, "target"), (0, "background")):
        mine = (block.own[doc] if k else np.ones(len(doc), bool)) & leave_out
        seen = words[2 + k][first] - own_first * mine
        alone = (words[k][second] - own_second * mine + SMOOTHING) / (totals[side] - block.lengths[doc] * mine + SMOOTHING * vocabulary)
        together = pairs[k][pair] - n * mine
        likely = np.where(seen > 0, MIXED * together / np.maximum(seen, 1) + (1 - MIXED) * alone, alone)
        out[side] = np.bincount(doc, weights=-n * np.log(likely), minlength=docs)
    return out


def _scores(totals: dict[str, int], vocabulary: int, leave_out: bool) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in groups(batches, ["block"]):
            block, found = Block(frame.iloc[0]), frame.iloc[1:]
            words, pairs = (np.concatenate([np.zeros((n, 0), np.int64)] + [_counts_in(x, n) for x in found[c]], axis=1) for c, n in (("word_counts", 4), ("pair_counts", 2)))
            if words.shape[1] != len(block.vocabulary) or pairs.shape[1] != len(block.pairs):
                raise ValueError(f"block {frame['block'].iloc[0]}: answers are missing")
            loss, n = _losses(block, words, pairs, totals, vocabulary, leave_out), block.lengths
            mean = {s: np.where(n > 0, x / np.maximum(n, 1), np.nan) for s, x in loss.items()}
            out = pd.DataFrame({"id": list(frame["ids"].iloc[0]), "n_words": n, "target_loss": mean["target"], "background_loss": mean["background"], "score": mean["target"] - mean["background"]})
            yield out.astype({c: "Float64" for c in ("target_loss", "background_loss", "score")}).mask(out.isna() & (out.columns != "id"), pd.NA)

    return judge


class Model:
    """The blocks of the training rows.  model[name] collects counts (see WORDS) by word number: for small inputs."""

    def __init__(self, docs: DataFrame, blocks: DataFrame, block_words: int):
        self.docs, self.blocks, self.block_words = docs, blocks, block_words

    def words(self) -> DataFrame:
        """word, and how often it stands in the background and in the target: as a word, as a history."""

        def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                for _, row in batch.iterrows():
                    block = Block(row)
                    yield pd.DataFrame({"word": block.vocabulary.view(np.int64)} | dict(zip(WORDS, block.word_counts(), strict=True)))

        return self.blocks.mapInPandas(decode, "word long, " + ", ".join(f"{c} long" for c in WORDS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in WORDS])

    def __getitem__(self, name: str) -> pd.Series:
        return self.words().select("word", name).toPandas().set_index("word")[name]


def train(docs: DataFrame, target: DataFrame, block_words: int = BLOCK_WORDS) -> Model:
    """Cuts the training rows (doc_id, text) into blocks.  target: a doc_id for each row of the target."""
    own = target.select(F.col("doc_id").alias("_own")).where("_own is not null").distinct()
    rows = docs.select("doc_id", "text").join(few(own), F.col("doc_id") == F.col("_own"), "left")
    return Model(docs, cut(rows.select(F.col("doc_id").alias("id"), F.col("_own").isNotNull().alias("own"), "text"), block_words), block_words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_words, target_loss, background_loss (means over the words) and score, their difference, of each row.

    docs: those of the model, which then leave themselves out, or others.
    """
    leave_out = docs is model.docs
    blocks = model.blocks if leave_out else cut(docs.select(F.col("doc_id").alias("id"), F.lit(False).alias("own"), "text"), model.block_words)
    n = model.blocks.agg(F.sum("n")).first()[0] or 0
    buckets = max(BUCKETS, -(-n // BUCKET_WORDS))
    asked = model.blocks.mapInPandas(lambda b: _requests(buckets, True, leave_out, b), _REQUEST)
    if not leave_out:
        asked = asked.unionByName(blocks.mapInPandas(lambda b: _requests(buckets, False, True, b), _REQUEST))
    answers = materialise(asked.repartition("bucket").sortWithinPartitions("bucket").mapInPandas(_answers, _ANSWER), "lm-answers")
    row = answers.where("block is null").agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "background", "target")]).first()
    totals = {"background": row["background"], "target": row["target"]}
    found = answers.where("block is not null").select("block", "bucket", "word_counts", "pair_counts")
    both = blocks.withColumn("bucket", F.lit(-1)).unionByName(found, allowMissingColumns=True)
    dealt = both.repartition("block").sortWithinPartitions("block", "bucket")
    # and one word for all that the background doesn't have
    scored = dealt.mapInPandas(_scores(totals, row["n_words"] + 1, leave_out), "id string, n_words long, target_loss double, background_loss double, score double")
    scored = materialise(scored, "lm-scores")
    discard(answers)
    return scored.select(F.col("id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "n_words", "target_loss", "background_loss", "score")
