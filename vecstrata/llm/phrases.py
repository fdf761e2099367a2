"""Collocations of two to four words, by growing contiguous phrases to the right.

Words are counted by language first; only words that occur ``least`` times can be
part of a frequent phrase.  Every place in a text whose word and next word are such
words is an occurrence pointer with what lies to its right: the next words of its
piece, up to four in all and up to the first word that is not frequent.  Equal
pointers of a block of text are counted before they move.

Pointers are projected on prefixes: all that begin with the same word go to the same
slot, and a slot grows its prefixes one after the other, depth first, over its sorted
pointers.  A prefix whose pointers could be more than a slot should hold is dealt out
by its next word: a word that occurs more than ``hot`` times does not decide a slot
alone, the words after it join in until one is rare enough.  So no slot gets more
than ``hot`` pointers of a prefix it was dealt by, and a prefix of four such words is
one counted pointer a block.  A phrase that is shorter than what decided the slot is
counted in several slots; these parts are summed.

Words are 64-bit hashes of language and word while they move.  Every block checks
that its words of equal hash are equal bytes, and the table of all words that no two
words share a hash; if two do, all is counted again with another seed.

The filter of frequent words is a bitmap of at most ``FILTER`` bits.  If it is full,
more pointers move, and the counts stay the same.

Score and drop rule are exact (decimal) arithmetic over the counts.

Defined cases: null texts are empty and null languages ``und``; repeated rows count
each; a text of any length is one block; an empty table gives no rows; other columns
are not read; ties are settled by the order of the result, phrases being distinct.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .lean import give_back, lean
from .packing import packed, runs, unpacked
from .scratch import power_of_two, settle, written
from .words import CHUNK, LOWER, _powers_to, mixed

MOST_WORDS = 4
#: Bytes of text of a block, at most, but for a longer text.
BLOCK = 1 << 22
#: Pointers that a slot stands for, and slots at least.
SLOT, LEAST_SLOTS = 1 << 20, 64
#: Bits of the filter of frequent words, at most.
FILTER = 1 << 27
#: Bytes that end a piece, bytes that end a word.
BREAK = np.zeros(256, bool)
BREAK[[*b".,;:!?", 10, 11, 12, 13]] = True
IN_WORD = ~BREAK
IN_WORD[[9, 32]] = False

Batches = Iterator[pa.RecordBatch]
DEALT = "slot bigint, n bigint, m bigint, words binary, first binary, rest binary, counts binary"
KEYS = [f"w{k}" for k in range(MOST_WORDS)]


def blocks(batches: Batches) -> Iterator[tuple[np.ndarray, list[str], np.ndarray]]:
    """(bytes of the texts, each ended by a line end, names of languages, language of each text with its length) of some rows together."""
    texts: list[bytes] = []
    langs: list[str] = []
    size = 0

    def block():
        names = sorted(set(langs))
        at = {x: k for k, x in enumerate(names)}
        of = np.repeat(np.array([at[x] for x in langs]), [len(t) + 1 for t in texts])
        return np.frombuffer(b"\n".join([*texts, b""]), np.uint8), names, of.astype(np.int32)

    for b in batches:
        for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
            texts.append(text.as_buffer().to_pybytes() if text.is_valid else b"")
            langs.append(lang.as_py())
            size += len(texts[-1])
            if size >= BLOCK:
                yield block()
                texts, langs, size = [], [], 0
    if texts:
        yield block()


def seeds(names: list[str], seed: int) -> np.ndarray:
    """A number for each language, to mix into the hashes of its words."""
    return np.array([int.from_bytes(hashlib.blake2b(x.encode(), digest_size=8, salt=seed.to_bytes(8, "little")).digest(), "little") for x in names], np.uint64)


def words(raw: np.ndarray, names: list[str], of: np.ndarray, seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends, hashes, pieces) of the words of a block; a word's piece has a number of its own."""
    low = LOWER[raw]
    turns = np.flatnonzero(np.diff(IN_WORD[low], prepend=False, append=False))
    starts, ends = turns[::2], turns[1::2]
    h = np.zeros(len(starts), np.uint64)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(ends, starts[at] + CHUNK)))
        first, last = starts[at], ends[end - 1]
        up, down = _powers_to(int(last - first) + 1)
        sums = np.zeros(int(last - first) + 1, np.uint64)
        np.cumsum((low[first:last].astype(np.uint64) + np.uint64(1)) * up[: last - first], out=sums[1:])
        s, e = starts[at:end] - first, ends[at:end] - first
        h[at:end] = (sums[e] - sums[s]) * down[s] + (e - s).astype(np.uint64)
        at = end
    lang = of[starts] if len(starts) else np.zeros(0, np.int32)
    h = mixed(h ^ seeds(names, seed)[lang]) if len(names) else h
    pieces = np.cumsum(BREAK[low], dtype=np.int32)[starts] if len(starts) else lang
    return low, starts, ends, np.maximum(h, np.uint64(1)), pieces  # 0 means no word


def count_words(seed: int) -> Callable[[Batches], Batches]:
    """(lang, word, h, n, clash) of the words of each block; ``clash``: its hash has other bytes in the block as well."""

    def run(batches: Batches) -> Batches:
        for raw, names, of in blocks(batches):
            low, starts, ends, h, _ = words(raw, names, of, seed)
            found, first, at, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
            size = ends - starts
            alike = (size == size[first][at]) & (of[starts] == of[starts[first]][at])
            offset = np.arange(size[alike].sum()) - np.repeat(np.cumsum(size[alike]) - size[alike], size[alike])
            mine, theirs = np.repeat(starts[alike], size[alike]) + offset, np.repeat(starts[first][at][alike], size[alike]) + offset
            clash = not alike.all() or bool((low[mine] != low[theirs]).any())
            whole = low.tobytes()
            spelt = pa.array([whole[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)], pa.binary())
            lang = pa.DictionaryArray.from_arrays(pa.array(of[starts[first]], pa.int32()), pa.array(names, pa.string())).cast(pa.string()) if len(first) else pa.array([], pa.string())
            yield pa.RecordBatch.from_arrays([lang, spelt, pa.array(found.view(np.int64)), pa.array(n, pa.int64()), pa.array(np.full(len(n), clash))], names=["lang", "word", "h", "n", "clash"])

    return lean(run)


def frequent_bits(frequent: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of the hashes ``h``; at most FILTER / 64 words of it reach the driver."""
    place = F.pmod(F.col("h"), F.lit(bits))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod(place, F.lit(64)).cast("int"))
    made = frequent.groupBy(F.floor(place / 64).cast("bigint").alias("at")).agg(F.bit_or(one).alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[made["at"].to_numpy()] = made["mask"].to_numpy()
    return out.view(np.uint64)


def in_filter(h: np.ndarray, filter_: np.ndarray) -> np.ndarray:
    place = h & np.uint64(64 * len(filter_) - 1)
    return filter_[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63)) & np.uint64(1) > 0


def pointers(word: np.ndarray, pieces: np.ndarray) -> np.ndarray:
    """A line of up to four words from each word on that has a next one in its piece; ``word`` 0 is none, and 0 stands where a line ends."""
    out = np.zeros((len(word), MOST_WORDS), word.dtype)
    out[:, 0] = word
    for k in range(1, min(MOST_WORDS, len(word))):
        goes_on = (pieces[k:] == pieces[:-k]) & (out[:-k, k - 1] > 0)
        out[:-k, k] = np.where(goes_on, word[k:], 0)
    return out[out[:, 1] > 0]


def slots_of(lines: np.ndarray, found: np.ndarray, hot: np.ndarray, slots: int) -> np.ndarray:
    """The slot of each line, decided by its words up to the first that is not hot."""
    warm = np.isin(found, hot) if len(hot) else np.zeros(len(found), bool)
    key, going = found[lines[:, 0]], warm[lines[:, 0]]
    for k in range(1, MOST_WORDS):
        key = np.where(going, mixed(key * np.uint64(3) + found[lines[:, k]]), key)
        going &= warm[lines[:, k]]
    return (mixed(key) >> np.uint64(33)) * np.uint64(slots) >> np.uint64(31)


def project(seed: int, slots: int, shared) -> Callable[[Batches], Batches]:
    """The pointers of each block by slot, sorted and counted, as arrays over the words that occur in them."""

    def run(batches: Batches) -> Batches:
        filter_, hot = shared.value
        for raw, names, of in blocks(batches):
            _, _, _, h, pieces = words(raw, names, of, seed)
            kept = in_filter(h, filter_)
            found, at = np.unique(h[kept], return_inverse=True)
            found = np.concatenate((np.zeros(1, np.uint64), found))
            word = np.zeros(len(h), np.int64)
            word[kept] = at + 1
            lines = pointers(word, pieces)
            if not len(lines):
                continue
            slot = slots_of(lines, found, hot, slots)
            order = np.lexsort((lines[:, 2] << 32 | lines[:, 3], lines[:, 0] << 32 | lines[:, 1], slot))
            lines, slot = lines[order], slot[order]
            new = np.flatnonzero(np.concatenate(([True], (lines[1:] != lines[:-1]).any(1) | (slot[1:] != slot[:-1]))))
            n = np.diff(np.append(new, len(lines)))
            lines, slot = lines[new], slot[new]
            bounds = np.append(np.flatnonzero(np.diff(slot, prepend=np.uint64(1 << 63))), len(slot))
            rows = []
            for x, y in zip(bounds[:-1], bounds[1:], strict=True):
                mine_, to = np.unique(lines[x:y], return_inverse=True)
                to = to.reshape(y - x, MOST_WORDS)
                first = np.diff(to[:, 0], prepend=0)  # sorted, so the steps are small
                rows.append((int(slot[x]), int(y - x), len(mine_), packed(np.diff(found[mine_], prepend=np.uint64(0))), packed(first), packed(to[:, 1:].T.reshape(-1)), packed(n[x:y])))
            kinds = (pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * 4)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in DEALT.split(", ")])
            give_back()

    return run


class Growth:
    """Frequent phrases of a slot's pointers, found depth first."""

    def __init__(self, lines: np.ndarray, counts: np.ndarray, found: np.ndarray, hot: np.ndarray, least: int):
        self.lines, self.found, self.least = lines, found, least
        self.sums = np.concatenate(([0], np.cumsum(counts)))
        self.hot = np.isin(found, hot)
        change = np.ones(len(lines), bool)
        self.heads = []  # where the first k + 1 words change
        for k in range(MOST_WORDS):
            now = np.concatenate(([True], lines[1:, k] != lines[:-1, k]))
            change = now if k == 0 else change | now
            self.heads.append(np.flatnonzero(change))
        self.out: list[tuple[np.ndarray, np.ndarray]] = []

    def grow(self, low: int, high: int, depth: int, split: bool) -> None:
        """Extend the prefix that the pointers ``low`` to ``high`` share by one word, and each frequent extension in turn.

        ``split``: all words of the prefix are hot, so that other slots may hold more of its extensions.
        """
        heads = self.heads[depth]
        a, b = np.searchsorted(heads, (low, high))
        first = heads[a:b]
        last = np.append(first[1:], high)
        word, n = self.lines[first, depth], self.sums[last] - self.sums[first]
        also = self.hot[word] if split else np.zeros(len(word), bool)
        take = (self.found[word] > 0) & ((n >= self.least) | also)
        if not take.any():
            return
        first, last, n, also = first[take], last[take], n[take], also[take]
        if depth:
            phrase = self.found[self.lines[first, : depth + 1]]
            self.out.append((np.pad(phrase, ((0, 0), (0, MOST_WORDS - depth - 1))), n))
        if depth + 1 < MOST_WORDS:
            for x, y, s in zip(first.tolist(), last.tolist(), also.tolist(), strict=True):
                self.grow(x, y, depth + 1, s)


def mine(least: int, shared) -> Callable[[Batches], Batches]:
    """(w0 to w3, a) of the phrases that each slot finds; those of which other slots may hold more occurrences come with what is here."""

    def run(batches: Batches) -> Batches:
        hot = shared.value[1]
        for rows in runs(batches, "slot"):
            own = [np.cumsum(unpacked(r["words"], r["m"]), dtype=np.uint64) for r in rows]
            found, to = np.unique(np.concatenate([np.zeros(1, np.uint64), *own]), return_inverse=True)
            at, parts = 1, []
            for r in rows:
                lines = np.vstack((np.cumsum(unpacked(r["first"], r["n"]))[None], unpacked(r["rest"], r["n"] * (MOST_WORDS - 1)).reshape(MOST_WORDS - 1, -1))).T.astype(np.int32)
                parts.append(to[at : at + r["m"]].astype(np.int32)[lines])
                at += r["m"]
            lines, counts = np.concatenate(parts), np.concatenate([unpacked(r["counts"], r["n"]).astype(np.int64) for r in rows])
            del parts, own, rows
            order = np.lexsort((lines[:, 3].astype(np.int64) | lines[:, 2].astype(np.int64) << 32, lines[:, 1].astype(np.int64) | lines[:, 0].astype(np.int64) << 32))
            g = Growth(lines[order], counts[order], found, hot, least)
            g.grow(0, len(lines), 0, True)
            if g.out:
                phrases, n = np.concatenate([p for p, _ in g.out]), np.concatenate([n for _, n in g.out])
                yield pa.RecordBatch.from_arrays([*(pa.array(phrases[:, k].copy().view(np.int64)) for k in range(MOST_WORDS)), pa.array(n, pa.int64())], names=[*KEYS, "a"])
            give_back()

    return run


def _counted_words(rows: DataFrame) -> tuple[DataFrame, int]:
    """(h, lang, word, f) of all words, with the seed under which no two of them share a hash."""
    for seed in range(8):
        made, _ = written(rows.mapInArrow(count_words(seed), "lang string, word binary, h bigint, n bigint, clash boolean").groupBy("h", "lang", "word").agg(F.sum("n").alias("f"), F.bool_or("clash").alias("clash")))
        if made.where("clash").isEmpty() and made.groupBy("h").count().where("count > 1").isEmpty():
            return made.drop("clash"), seed
    raise RuntimeError("two words share a hash under every seed")


def _key(words_: list[Column | None]) -> list[Column]:
    return [w if w is not None else F.lit(0).cast("bigint") for w in [*words_, *[None] * (MOST_WORDS - len(words_))]]


def frequent_phrases(rows: DataFrame, frequent: DataFrame, total: int, seed: int, least: int, slots: int | None = None, hot: int | None = None) -> DataFrame:
    """(w0 to w3, a): all phrases of two to four words that occur ``least`` times in ``rows(lang, text)``, as hashes, 0 after the last."""
    spark: SparkSession = rows.sparkSession
    slots = slots or max(LEAST_SLOTS, -(-total // SLOT))
    hot = hot or max(least, total // slots)
    bits = power_of_two(16 * frequent.count(), 1 << 16, FILTER)
    often = frequent.where(F.col("f") > hot).select("h").toArrow()["h"].to_numpy()  # at most as many as there are slots
    shared = spark.sparkContext.broadcast((frequent_bits(frequent, bits), np.sort(often.astype(np.int64).view(np.uint64))))
    dealt = rows.mapInArrow(project(seed, slots, shared), DEALT)
    found = dealt.repartition("slot").sortWithinPartitions("slot").mapInArrow(mine(least, shared), ", ".join(f"{k} bigint" for k in [*KEYS, "a"]))
    return found.groupBy(*KEYS).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _parts_of(phrases: DataFrame) -> DataFrame:
    """Each contiguous part of two words or more of each phrase, with the count of the longest-lived phrase around it."""
    w = [F.col(k) for k in KEYS]
    none = F.lit(0).cast("bigint")
    spans = [(i, n) for n in range(2, MOST_WORDS) for i in range(MOST_WORDS - n + 1)]
    part = F.array(*[F.when((w[i + n - 1] != 0) & (F.lit(True) if i else w[n] != 0), F.struct(*[x.alias(k) for k, x in zip(KEYS, _key(w[i : i + n]), strict=True)])) for i, n in spans])
    made = phrases.where(w[2] != none).select("a", F.explode(F.filter(part, lambda x: x.isNotNull())).alias("part"))
    return made.select("part.*", "a").groupBy(*KEYS).agg(F.max("a").alias("around"))


def _scored(phrases: DataFrame, single: DataFrame) -> DataFrame:
    """``phrases`` with l, r and score of the lowest-scoring cut (ties: the earliest)."""
    w = [F.col(k) for k in KEYS]
    cut = F.array(
        *[
            F.when(w[k] != 0, F.struct(F.lit(k).alias("k"), F.struct(*[x.alias(f"l{i}") for i, x in enumerate(_key(w[:k]))]).alias("left"), F.struct(*[x.alias(f"r{i}") for i, x in enumerate(_key(w[k:]))]).alias("right")))
            for k in range(1, MOST_WORDS)
        ]
    )
    counts = phrases.unionByName(single)
    side = lambda s: counts.select(*[F.col(x).alias(f"{s}{i}") for i, x in enumerate(KEYS)], F.col("a").alias(s))
    cuts = phrases.select("*", F.explode(F.filter(cut, lambda x: x.isNotNull())).alias("cut")).select(*KEYS, "a", "cut.k", "cut.left.*", "cut.right.*")
    both = cuts.join(side("l"), [f"l{i}" for i in range(MOST_WORDS)]).join(side("r"), [f"r{i}" for i in range(MOST_WORDS)])
    score = F.expr("(cast(2000000 as decimal(7,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = both.withColumn("score", score).groupBy(*KEYS).agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("best"))
    return best.select(*KEYS, "a", "best.l", "best.r", "best.score")


def collocations(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", least: int = 30, most: int = 2000, slots: int | None = None, hot: int | None = None) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``most`` phrases of each language."""
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    table, seed = _counted_words(rows)
    totals = settle(table.groupBy("lang").agg(F.sum("f").alias("n")))
    frequent = settle(table.where(F.col("f") >= least))
    total = totals.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    phrases, _ = written(frequent_phrases(rows, frequent, total, seed, least, slots, hot))
    single = frequent.select(F.col("h").alias("w0"), *[F.lit(0).cast("bigint").alias(k) for k in KEYS[1:]], F.col("f").alias("a"))
    scored = _scored(phrases, single)
    covered = F.expr("cast(100 as decimal(3,0)) * cast(around as decimal(20,0)) >= cast(80 as decimal(3,0)) * cast(a as decimal(20,0))")
    alone = scored.join(_parts_of(phrases), KEYS, "left").where(F.col("around").isNull() | ~covered).drop("around")
    named = alone.join(frequent.select(F.col("h").alias("w0"), "lang"), "w0")
    near = settle(named.withColumn("rank", F.rank().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a")))).where(F.col("rank") <= most).drop("rank"))
    spelt = reduce(
        lambda df, k: df.join(frequent.select(F.col("h").alias(k), F.col("word").cast("string").alias(f"{k}_word")), k, "left"), KEYS, near
    ).withColumn("phrase", F.concat_ws(" ", *[f"{k}_word" for k in KEYS]))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    first = spelt.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    return first.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")
