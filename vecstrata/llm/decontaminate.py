"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of ``HALF`` words; two neighbouring ones make a
search window, so windows overlap by half.  The term space are the distinct
words of the benchmark block at hand, a bounded number; passages are TF-IDF
vectors over it with document frequencies from all passages, each term scaled to
equal energy, or else the frequent words would take all leading directions.  A
distributed randomised SVD follows: each task multiplies its passages into a seeded Gaussian
test matrix and back (Z = A'AW, summed over tasks), and the Nystroem formula
turns Z into the leading right singular vectors, without a second pass.  Windows
and benchmark items are projected on them, and pairs with a cosine of at least
``COSINE`` are candidates, all of them.

A candidate is confirmed on words: the longest common subsequence of the item
and the region around the window covers ``SURE`` of the item, or it covers
``PARAPHRASE`` and the region holds the item's answer, its last sentence, too.

Items of under ``RUNS`` words are too short for a cosine to tell, so they are also
looked up whole: the runs of their first ``RUN`` words (all of them, if fewer) are
kept as hashes, every run of the documents is looked up there, and what follows is
compared word by word.

The benchmark is read in blocks of at most ``BLOCK_BYTES``; each is broadcast
and searched in all documents, so its size bounds the broadcast, not the
benchmark.

Defined cases: null and empty texts match nothing; items without words match
nothing; items of under ``SHORT`` words must occur whole and in sequence; an item that
only the look-up finds has a null cosine;
documents and items of any length are read whole; rows with null ids are
searched and reported under null; repeated rows are reported each; an empty
table on either side gives no matches; other columns pass a filter unchanged.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import filtered, lean
from .words import chunks, hashed_words, mixed

HALF, RANK, SEED = 32, 96, 7
COSINE, SURE, PARAPHRASE, ANSWER, SHORT = 0.45, 0.65, 0.5, 0.8, 8
#: Words of an item that one query vector stands for, at most; longer items have several.
SEGMENT = 64
BLOCK_BYTES = 4 << 20
#: Items of fewer words are also looked up whole, by their first words.
RUNS, RUN = 16, 5
#: Terms of the space summed in one row, and matrix rows held at a time.
TERMS, STEP = 64, 1_500


class Items:
    """A block of the benchmark: items as term numbers, their answers and query segments."""

    def __init__(self, rows: list[tuple[int | None, str | None]]):
        raw = [(text or "").encode() for _, text in rows]
        h, bounds = hashed_words(raw)
        self.terms, numbers = np.unique(h, return_inverse=True)
        self.ids = [i for i, _ in rows]
        self.words = [numbers[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        self.answers = []
        for text, words in zip(raw, self.words, strict=True):
            last = next((s for s in reversed(re.split(rb"[.!?\n]+", text)) if len(hashed_words([s])[0])), b"")
            size = max(len(hashed_words([last])[0]), min(5, len(words)))
            self.answers.append(words[len(words) - size :])
        self.owner, segments = [], []
        for k, words in enumerate(self.words):
            for at in range(0, len(words), SEGMENT):
                self.owner.append(k)
                segments.append(words[max(0, min(at, len(words) - SEGMENT)) : at + SEGMENT])
        self.segments = segments

    def numbered(self, h: np.ndarray) -> np.ndarray:
        """Term numbers of word hashes, -1 for words that the block has not."""
        if not len(self.terms):
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, h), len(self.terms) - 1)
        return np.where(self.terms[at] == h, at, -1)


def _cells(numbers: np.ndarray, bounds: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Passages as (row, term, count), rows in order, and the first row of each text and after the last."""
    sizes = np.diff(bounds)
    firsts = np.concatenate(([0], np.cumsum(-(-sizes // HALF))))
    within = np.arange(len(numbers)) - np.repeat(bounds[:-1], sizes)
    row = np.repeat(firsts[:-1], sizes) + within // HALF
    known = numbers >= 0
    key, count = np.unique(row[known] * terms + numbers[known], return_counts=True)
    return key // max(terms, 1), key % max(terms, 1), count, firsts


def _times(row: np.ndarray, col: np.ndarray, value: np.ndarray, matrix: np.ndarray, rows: int) -> np.ndarray:
    """Sparse times dense, in steps of bounded size."""
    out = np.zeros((rows, matrix.shape[1]), np.float32)
    for at in range(0, len(row), STEP):
        r, part = row[at : at + STEP], value[at : at + STEP, None] * matrix[col[at : at + STEP]]
        starts = np.flatnonzero(np.diff(r, prepend=-1))
        out[r[starts]] += np.add.reduceat(part, starts)
    return out


def _frequency_batches(items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = items.value
        seen, total = np.zeros(len(block.terms) + 1, np.int64), 0
        for b in batches:
            for texts in chunks(t.as_py() for t in b.column(0)):
                h, bounds = hashed_words(texts)
                _, col, _, firsts = _cells(block.numbered(h), bounds, len(block.terms))
                seen[:-1] += np.bincount(col, minlength=len(block.terms))
                total += int(firsts[-1])
        seen[-1] = total
        terms = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(seen[terms], pa.int64())], names=["term", "n"])

    return run


def _sketch_batches(items, weights):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (idf, test) = items.value, weights.value
        z = np.zeros((len(block.terms), test.shape[1]))
        for b in batches:
            for texts in chunks(t.as_py() for t in b.column(0)):
                h, bounds = hashed_words(texts)
                row, col, count, firsts = _cells(block.numbered(h), bounds, len(block.terms))
                if not len(row):
                    continue
                value = (count * idf[col]).astype(np.float32)
                norm = np.sqrt(np.bincount(row, value * value, minlength=firsts[-1]))
                value /= norm[row].astype(np.float32)
                y = _times(row, col, value, test, int(firsts[-1]))
                order = np.argsort(col, kind="stable")
                z += _times(col[order], row[order], value[order], y, len(z))
        for at in range(0, len(z), TERMS):
            part = z[at : at + TERMS]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([at // TERMS], pa.int64()), pa.array([part.astype("<f8").tobytes()], pa.binary())], names=["block", "z"])

    return run


def _sum_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[int, np.ndarray] = {}
    for b in batches:
        for block, z in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            more = np.frombuffer(z.as_py(), "<f8")
            sums[block] = sums[block] + more if block in sums else more
    if sums:
        yield pa.RecordBatch.from_arrays([pa.array(sums, pa.int64()), pa.array([x.tobytes() for x in sums.values()], pa.binary())], names=["block", "z"])


def singular_vectors(test: np.ndarray, z: np.ndarray) -> np.ndarray:
    """Leading right singular vectors of A from W and Z = A'AW."""
    core = test.T.astype(float) @ z
    core = (core + core.T) / 2
    values, vectors = np.linalg.eigh(core)
    keep = values > max(values.max(initial=0), 0) * 1e-10
    if not keep.any():
        return np.zeros((len(z), 1), np.float32)
    u, _, _ = np.linalg.svd((z @ vectors[:, keep]) / np.sqrt(values[keep]), full_matrices=False)
    return u.astype(np.float32)


def _run_keys(numbers: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` terms."""
    key = np.zeros(len(numbers) - size + 1, np.uint64)
    for k in range(size):
        key = mixed(key + numbers[k : k + len(key)].astype(np.uint64))
    return key


class LatentIndex:
    """The space of a benchmark block and the queries in it; answers for lists of texts."""

    def __init__(self, items: Items, idf: np.ndarray, basis: np.ndarray):
        self.items, self.scaled = items, (idf[:, None] * basis).astype(np.float32)
        queries = [np.bincount(s, minlength=len(items.terms)) @ self.scaled for s in items.segments] or [np.zeros(basis.shape[1])]
        q = np.array(queries)
        self.queries = (q / np.maximum(np.linalg.norm(q, axis=1, keepdims=True), 1e-12)).astype(np.float32)
        self.runs: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        sizes = np.array([len(w) for w in items.words])
        for size in range(1, RUN + 1):
            mine = np.flatnonzero((sizes == size) | (sizes > RUN) & (sizes < RUNS) & (size == RUN))
            if len(mine):
                firsts = np.concatenate([_run_keys(items.words[k][:size], size) for k in mine])
                order = np.argsort(firsts, kind="stable")
                keys, starts = np.unique(firsts[order], return_index=True)
                self.runs[size] = keys, np.append(starts, len(mine)), mine[order]
        self.masks = []
        for words in items.words:
            mask: dict[int, int] = {}
            for k, w in enumerate(words.tolist()):
                mask[w] = mask.get(w, 0) | 1 << k
            self.masks.append(mask)
        self.answer_masks = []
        for words in items.answers:
            mask = {}
            for k, w in enumerate(words.tolist()):
                mask[w] = mask.get(w, 0) | 1 << k
            self.answer_masks.append(mask)

    def candidates(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, int, float]]:
        """(text, item, first word of the window in its text, cosine) of all pairs over the threshold."""
        row, col, count, firsts = _cells(numbers, bounds, len(self.items.terms))
        if not self.items.owner or not len(row):
            return
        halves = _times(row, col, count.astype(np.float32), self.scaled, int(firsts[-1]))
        text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
        window = halves.copy()
        joins = np.flatnonzero(text[1:] == text[:-1])
        window[joins] += halves[joins + 1]
        norm = np.linalg.norm(window, axis=1)
        full = np.flatnonzero(norm > 1e-9)
        owner = np.array(self.items.owner)
        for at in range(0, len(full), 4096):
            rows = full[at : at + 4096]
            cosine = (window[rows] / norm[rows, None]) @ self.queries.T
            for r, q in zip(*np.nonzero(cosine >= COSINE), strict=True):
                k = rows[r]
                yield int(text[k]), int(owner[q]), int(k - firsts[text[k]]) * HALF, float(cosine[r, q])

    def whole(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int]]:
        """(text, item) of the short items that occur whole."""
        for size, (keys, starts, items) in self.runs.items():
            if len(numbers) < size:
                continue
            found = _run_keys(numbers, size)
            at = np.minimum(np.searchsorted(keys, found), len(keys) - 1)
            for k in np.flatnonzero(keys[at] == found):
                text = int(np.searchsorted(bounds, k, "right")) - 1
                for item in items[starts[at[k]] : starts[at[k] + 1]]:
                    words = self.items.words[item]
                    if k + len(words) <= bounds[text + 1] and (numbers[k : k + len(words)] == words).all():
                        yield text, int(item)

    def search(self, texts: list[bytes]) -> Iterator[tuple[int, int, float | None, float, bool]]:
        """(text, item, cosine, share of the item in common, answer found) of confirmed pairs."""
        h, bounds = hashed_words(texts)
        numbers = self.items.numbered(h)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for text, item, at, cosine in self.candidates(numbers, bounds):
            mine = numbers[bounds[text] : bounds[text + 1]]
            size = len(self.items.words[item])
            region = mine[max(0, at - size) : at + 2 * HALF + size].tolist()
            share, found = self.confirm(region, item)
            if share and (share, cosine) > best.get((text, item), (0.0, 0.0, False))[:2]:
                best[text, item] = share, cosine, found
        for pair in self.whole(numbers, bounds):
            best[pair] = 1.0, best[pair][1] if pair in best else None, True
        for (text, item), (share, cosine, found) in sorted(best.items()):
            yield text, item, cosine, share, found

    def confirm(self, region: list[int], item: int) -> tuple[float, bool]:
        """(share of the item that the region has in order, whether it has the answer); share 0 if not confirmed."""
        mask, words = self.masks[item], self.items.words[item]
        size = len(words)
        known = [w for w in region if w in mask]
        if len(known) < PARAPHRASE * size:
            return 0.0, False
        if size < SHORT:
            whole = words.tolist()
            found = any(region[k : k + size] == whole for k in range(len(region) - size + 1))
            return float(found), found
        if common(known, mask, size) < PARAPHRASE * size:
            return 0.0, False
        # the region is wider than the item; what counts is the closest stretch of about its length
        answer, wide, best = self.items.answers[item], size * 3 // 2 + 2, (0.0, False)
        for at in range(0, max(1, len(region) - wide + size // 4 + 1), max(1, size // 4)):
            part = region[at : at + wide]
            share = common(part, mask, size) / size
            if share < PARAPHRASE:
                continue
            found = common(part, self.answer_masks[item], len(answer)) >= ANSWER * len(answer)
            if share >= SURE or found:
                best = max(best, (share, found))
        return best


def common(region: list[int], mask: dict[int, int], size: int) -> int:
    """Length of the longest common subsequence of a region and the sequence whose places ``mask`` gives, by bits."""
    full = (1 << size) - 1
    row = full
    for w in region:
        m = mask.get(w)
        if m:
            u = row & m
            row = (row + u | row - u) & full
    return size - row.bit_count()


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[Items]:
    held, size = [], 0
    for r in benchmark.select(F.col(item_col).cast("bigint").alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        if held and size + len(r.t or "") > BLOCK_BYTES:
            yield Items(held)
            held, size = [], 0
        held.append((r.i, r.t))
        size += len(r.t or "")
    if held:
        yield Items(held)


def fit(texts: DataFrame, items: Items, rank: int = RANK) -> LatentIndex:
    """Document frequencies and singular vectors over all passages of ``texts(text)``."""
    context = texts.sparkSession.sparkContext
    shared = context.broadcast(items)
    seen = texts.mapInArrow(lean(_frequency_batches(shared)), "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    frequency = np.zeros(len(items.terms) + 1)
    for r in seen.collect():  # one row a term of the block at most
        frequency[r.term] = r.n
    idf = np.log1p((frequency[-1] + 1) / (frequency[:-1] + 1)) / np.sqrt(frequency[:-1] + 1)
    test = np.random.default_rng(SEED).standard_normal((len(items.terms), min(rank, max(1, len(items.terms))))).astype(np.float32)
    parts = texts.mapInArrow(lean(_sketch_batches(shared, context.broadcast((idf, test)))), "block bigint, z binary")
    z = np.zeros(test.shape)
    for r in parts.repartition("block").mapInArrow(lean(_sum_batches), "block bigint, z binary").toLocalIterator():
        part = np.frombuffer(r.z, "<f8").reshape(-1, test.shape[1])
        z[r.block * TERMS : r.block * TERMS + len(part)] = part
    return LatentIndex(items, idf, singular_vectors(test, z))


FOUND = "doc_id bigint, item_id bigint, cosine double, overlap double, answer_found boolean"


def _search_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            at, rows = 0, []
            for texts in chunks(t.as_py() for t in b.column(1)):
                rows += [(at + text, item, *rest) for text, item, *rest in index.search(texts)]
                at += len(texts)
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            ids = b.column(0).take(pa.array(columns[0], pa.int64()))
            items = pa.array([index.items.ids[k] for k in columns[1]], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [ids, items, *(pa.array(c, kind) for c, kind in zip(columns[2:], (pa.float64(), pa.float64(), pa.bool_()), strict=True))],
                names=["doc_id", "item_id", "cosine", "overlap", "answer_found"],
            )

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per document and benchmark item that it holds: doc_id, item_id, cosine, overlap, answer_found."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    found = None
    for items in _blocks(benchmark, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(fit(rows.select("text"), items))
        part = rows.mapInArrow(lean(_search_batches(index)), FOUND)
        found = part if found is None else found.unionByName(part)
    return docs.sparkSession.createDataFrame([], FOUND) if found is None else found


def _clean_batches(shared, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        for b in batches:
            keep, start = [True] * b.num_rows, 0
            for texts in chunks(t.as_py() for t in b.column(at).cast(pa.binary())):
                for text, *_ in index.search(texts):
                    keep[start + text] = False
                start += len(texts)
            yield from filtered(b, keep)

    return run


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that hold a benchmark item, all columns unchanged."""
    texts, kept = docs.select(F.col(text_col).cast("binary").alias("text")), docs
    for items in _blocks(benchmark, item_col, item_text_col):
        index = docs.sparkSession.sparkContext.broadcast(fit(texts, items))
        kept = kept.mapInArrow(lean(_clean_batches(index, docs.columns.index(text_col))), docs.schema)
    return kept
