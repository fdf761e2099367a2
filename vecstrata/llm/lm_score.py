"""Cross-entropy difference of two matched n-gram models.

The target model is counted over the target documents, the background model
over all documents.  Both are bigram models interpolated with unigrams over one
shared vocabulary, the distinct words of the whole corpus and the sign for the
start of a text; the background counts are scaled to the target's size, so that
the same smoothing weighs the same in both (matched models).  The score of a
document is its mean loss per token under the target model minus that under the
background model: the lower, the more the document is like the target.

All documents are counted and all are scored, whole, with exact counts of the
63-bit hashes of words and pairs; nothing of them is broadcast or capped.  A
batch are neighbouring rows of one file split, some ``BATCH`` bytes of text at
most.  While the table is scanned, each batch sends its distinct n-grams with
their counts to the slots, ranges of the hashes, whose number grows with the
corpus.  A slot sums the counts of all batches and answers each batch, in the
order of its n-grams.  The texts then meet their batch's answers, which is the
only time that they are shuffled, and are scored.  A batch's name is made of
its rows' places in the files, so a task that runs again makes the same
batches; the number of answers is compared with the number of n-grams all the
same.  An input that is not a scan of files is written to the shared folder
first and read from there.

Target ids are broadcast up to ``TARGETS`` of them.  Beyond, they are joined by a
shuffle, and a second one brings the rows of a batch together again; the result is
the same.

Defined cases: null and empty texts have no tokens and null losses; a document
named twice in the targets counts once; target ids without a document or null
ids are ignored; without any target text both models are the background's and
all scores are zero; repeated rows are counted and reported each; a text of any
length is one row of a batch; an empty table gives no rows; extra columns are
not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import packed, runs, unpacked
from .scratch import fresh_folder, sent, settle
from .words import hashed_words, mixed

#: Bytes of text that a batch has at most and at least on average, and that a slot stands for; least number of slots.
BATCH, LEAST_BATCH, SLOT, LEAST_SLOTS = 1 << 24, 1 << 20, 1 << 25, 64
#: Target ids that are broadcast, at most (8 bytes each).
TARGETS = 1 << 20
#: Weight of the bigram estimate, and what is added to each unigram count.
BIGRAM, ADD = 0.6, 0.5
START = np.uint64(0x5BD1E995)
ONE, PAIR = np.uint64(1), np.uint64(1 << 63)

ASK = "slot bigint, batch bigint, n bigint, keys binary, every binary, wanted binary, tokens bigint, tokens_wanted bigint"
ANSWER = "slot bigint, batch bigint, n bigint, every binary, wanted binary, tokens bigint, tokens_wanted bigint, words bigint"
SCORE = "doc_id bigint, n_tokens bigint, target_loss double, background_loss double, score double"


def ngrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys of the start sign, the words and the pairs, in turn; bounds of the texts in words; which texts have words).

    Words have keys below ``PAIR``, pairs from there on.
    """
    h, bounds = hashed_words(texts)
    before = np.empty_like(h)
    before[1:] = h[:-1]
    some = bounds[:-1] < bounds[1:]
    before[bounds[:-1][some]] = START
    return np.concatenate(([START >> ONE], h >> ONE, mixed(before * np.uint64(3) + h) >> ONE | PAIR)), bounds, some


def _table(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "double": pa.float64()}
    names = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t], from_pandas=True) for c, (_, t) in zip(zip(*rows, strict=True), names, strict=True)], names=[n for n, _ in names])


def _ask_batches(slots: int):
    """The distinct n-grams of each batch, by slot, with their counts in all texts and in target texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "batch"):
            keys, bounds, some = ngrams([r["text"] or b"" for r in rows])
            chosen = np.array([r["wanted"] for r in rows])
            found, at = np.unique(keys, return_inverse=True)
            tokens = np.repeat(chosen, np.diff(bounds))
            every = np.bincount(at[1:], minlength=len(found))
            wanted = np.bincount(at[1:][np.concatenate((tokens, tokens))], minlength=len(found))
            every[at[0]] += some.sum()
            wanted[at[0]] += (some & chosen).sum()
            sums = int(len(tokens) + some.sum()), int(tokens.sum() + (some & chosen).sum())
            slot = (found >> np.uint64(40)) * np.uint64(slots) >> np.uint64(24)
            cuts = np.flatnonzero(np.diff(slot, prepend=PAIR, append=PAIR))
            out = []
            for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                steps = np.diff(found[x:y], prepend=np.uint64(0))
                out.append((int(slot[x]), rows[0]["batch"], int(y - x), packed(steps), packed(every[x:y]), packed(wanted[x:y]), *(sums if not k else (0, 0))))
            yield _table(out, ASK)

    return run


def _answer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows with the sums over all batches in place of each one's counts, without the keys; ``words`` counts the slot's vocabulary."""
    for rows in runs(batches, "slot"):
        keys = np.concatenate([np.cumsum(unpacked(r["keys"], r["n"]), dtype=np.uint64) for r in rows])
        found, at = np.unique(keys, return_inverse=True)
        sums = [np.bincount(at, np.concatenate([unpacked(r[k], r["n"]) for r in rows])).astype(np.int64)[at] for k in ("every", "wanted")]
        words, end = int((found < PAIR).sum()), 0
        out = []
        for r in rows:
            part = slice(end, end + r["n"])
            out.append((r["slot"], r["batch"], r["n"], packed(sums[0][part]), packed(sums[1][part]), r["tokens"], r["tokens_wanted"], words))
            words, end = 0, part.stop
        yield _table(out, ANSWER)


def _score_batches(every: int, wanted: int, vocabulary: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs(batches, "batch"):
            docs, parts = [r for r in rows if r["slot"] < 0], [r for r in rows if r["slot"] >= 0]
            keys, bounds, some = ngrams([r["text"] or b"" for r in docs])
            found, at = np.unique(keys, return_inverse=True)
            if sum(r["n"] for r in parts) != len(found):
                raise RuntimeError("the rows of a file split changed between two reads")
            word, pair = at[1 : 1 + bounds[-1]], at[1 + bounds[-1] :]
            context = np.concatenate((at[:1], word[:-1]))[: len(word)]
            context[bounds[:-1][some]] = at[0]
            n, loss = np.diff(bounds), np.full((2, len(docs)), np.nan)
            counts = [np.concatenate([unpacked(r[k], r["n"]) for r in parts]).astype(float) for k in ("wanted", "every")]
            models = [(counts[0], wanted, 1.0), (counts[1], every, wanted / max(every, 1))] if wanted else [(counts[1], every, 1.0)] * 2
            for k, (c, total, scale) in enumerate(models):
                p = BIGRAM * c[pair] / np.maximum(c[context], 1)
                p += (1 - BIGRAM) * (c[word] * scale + ADD) / (total * scale + ADD * vocabulary)
                if some.any():
                    loss[k, some] = np.add.reduceat(-np.log(p), bounds[:-1][some]) / n[some]
            yield _table(list(zip([r["doc_id"] for r in docs], n, loss[0], loss[1], loss[0] - loss[1], strict=True)), SCORE)

    return run


def _flagged(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """``rows(batch, doc_id, text)`` with a column ``wanted``: whether the id is a target's; the rows of a batch stay together.

    A broadcast leaves the rows where they are.  A merge join deals them out by id,
    so they are brought together by batch again.
    """
    chosen = settle(targets.select(F.col(targets.columns[0]).cast("bigint").alias("of")).where("of is not null").distinct())
    side = sent(chosen, TARGETS)
    joined = rows.join(side, F.col("doc_id") == F.col("of"), "left").withColumn("wanted", F.col("of").isNotNull()).drop("of")
    return joined if chosen.count() <= TARGETS else joined.repartition("batch").sortWithinPartitions("batch")


def score(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, target_loss, background_loss, score.

    ``targets`` holds the target documents' ids in its first column.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    said = lambda df: df.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("file") == "").alias("loose")).first()
    named = lambda df: df.select("*", F.input_file_name().alias("file"))
    facts = said(named(rows))
    if facts.loose:
        folder = fresh_folder(spark, "lm")
        rows.write.parquet(folder)
        rows = spark.read.parquet(folder)
    size = facts.bytes or 0
    most = min(BATCH, max(LEAST_BATCH, size // 64))
    run, slots = max(1, facts.rows * most // max(size, 1)), max(LEAST_SLOTS, size // SLOT)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    batched = rows.select(F.xxhash64(F.input_file_name(), F.input_file_block_start(), F.floor(place / run)).alias("batch"), "doc_id", "text")
    asked = _flagged(batched, targets).select("batch", "text", "wanted").mapInArrow(_ask_batches(slots), ASK)
    answered = settle(asked.repartition("slot").sortWithinPartitions("slot").mapInArrow(_answer_batches, ANSWER))
    total = answered.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("tokens", "tokens_wanted", "words")]).first()
    mine = batched.select("batch", F.lit(-1).cast("bigint").alias("slot"), "doc_id", "text")
    joined = mine.unionByName(answered.select("batch", "slot", "n", "every", "wanted"), allowMissingColumns=True).repartition("batch").sortWithinPartitions("batch", "slot")
    return joined.mapInArrow(_score_batches(total.tokens, total.tokens_wanted, total.words), SCORE)
