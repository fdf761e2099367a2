"""BPE encoding by a walk over a trie of distinct words, and decoding.

Why prefixes can share work.  A token sequence is the encoding of its string
exactly if every two neighbouring tokens, joined and encoded on their own, come
back unchanged: merges never cross the final boundaries, so the merges inside a
pair are those of the pair alone.  The encoding of a word without its last token
is therefore the encoding of a shorter prefix, and one number for a prefix, its
last token, is enough to rebuild everything before it.  The state of a trie node
is found from the states above it: it is the only vocabulary entry ending there
that is compatible with the last token of the prefix it leaves.

The trie is kept as the sorted list of distinct words; a word's common prefix
with the one before it are the nodes they share, so each shared prefix is
computed once.  Words of up to ``LEVELS`` bytes are walked level by level, all
nodes of a level at once in numpy; the nodes of longer words, few to a level,
are walked depth first with a stack of states.

Texts are cut at special tokens, brought to NFC, lower-cased and cut at white
space as the vocabulary file prescribes; no word spans white space, so whole
white-space-free runs are numbered as they come, and the ids of a number are
remembered between texts, within a bound.

Defined cases: null and empty texts have no tokens and decode to the empty
text; texts of any length are read whole; rows keep their ids whatever they
are; an empty table gives no rows; extra columns are not read.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .lean import lean

END = "</w>"
#: Runs of text, and pairs of tokens of long words, remembered by a worker; the memory is emptied when full.
REMEMBER_RUNS, REMEMBER_PAIRS = 100_000, 150_000
#: Characters of text whose runs are looked up, and whose results leave a worker, together.
FLUSH = 1 << 20
NO_MERGE = (1 << 31) - 1
#: Numbers of tokens take fewer bits.
BITS = 20
#: Words of more bytes are walked depth first; words walked together; pairs of tokens remembered for them; runs cut together.
LEVELS, WORDS, PAIR_BITS, CUT = 64, 1 << 15, 16, 1 << 14


def byte_letters() -> list[str]:
    """The printable letter of each byte: itself where printable, else the next free one from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]


def _slots(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


class _Table:
    """Whole numbers by their keys, looked up for many keys at once; -1 where there is none."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(1, (2 * len(keys)).bit_length())
        self.last = (1 << self.bits) - 1
        self.keys, self.values = np.full(self.last + 1, -1, np.int64), np.full(self.last + 1, -1, np.int32)
        slot = _slots(keys, self.bits)
        while len(keys):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[free]
            mine = self.keys[slot] == keys
            self.values[slot[mine]] = values[mine]
            keys, values, slot = keys[~mine], values[~mine], slot[~mine] + 1 & self.last

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = _slots(keys, self.bits)
        found, out = self.keys[slot], self.values[slot]
        todo = np.flatnonzero((found != keys) & (found >= 0))
        out[todo] = -1
        slot = slot[todo]
        while len(todo):
            slot = slot + 1 & self.last
            found = self.keys[slot]
            hit = found == keys[todo]
            out[todo[hit]] = self.values[slot[hit]]
            on = ~hit & (found >= 0)
            todo, slot = todo[on], slot[on]
        return out


class _Numbers(dict):
    """Things by their numbers, in the order in which they were first asked for."""

    def __init__(self, first: int):
        super().__init__()
        self.first = first

    def __missing__(self, key: str) -> int:
        number = self[key] = self.first + len(self)
        return number


def _spread(flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts[k]`` items of ``flat`` from ``starts[k]`` on, for all k one after the other."""
    shift = starts - np.cumsum(counts) + counts
    at = np.repeat(shift, counts)
    at += np.arange(len(at))
    return flat[at]


class TrieEncoder:
    """Encoder for a vocabulary file with byte-level letters and word ends."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.merge: dict[int, int] = {}  # the rank of a pair of tokens
        self.product = array("i")  # what the pair of a rank becomes
        # the halves of a token and the rank that makes it; letters are there from the start
        self.left, self.right, self.made = (array("i", [-1]) * (max(vocab.values()) + 1) for _ in range(3))
        for rank, m in enumerate(model["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            left, right, new = vocab[a], vocab[b], vocab[a + b]
            self.merge[left << BITS | right] = rank
            self.product.append(new)
            self.left[new], self.right[new], self.made[new] = left, right, rank
        self.letters = byte_letters()
        to_byte = {c: b for b, c in enumerate(self.letters)}
        self.letter = {c: vocab[c] for x in self.letters for c in (x, x + END) if c in vocab}
        inner: dict[bytes, int] = {}
        final: dict[bytes, int] = {}
        for token, number in vocab.items():
            ends = token.endswith(END)
            body = token.removesuffix(END) if ends else token
            if body and all(c in to_byte for c in body):
                (final if ends else inner)[bytes(to_byte[c] for c in body)] = number
        self._automaton(inner, final)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.token: list[bytes | None] = [None] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, number in (*vocab.items(), *self.special.items()):
            self.token[number] = token.encode()
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        self.word = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.cutter = regex.compile(self.word.pattern + r"|\n")
        self.space = regex.compile(r"\p{White_Space}+")
        self.pairs: dict[int, bool] = {}
        self.whole = np.full(len(self.token), -1, np.int8)  # -1: not known yet
        self.pair_keys, self.pair_fits = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        # the number of each run; run k has the ids from ends[k - 1] to ends[k], the first numbers are the special tokens
        self.ids = _Numbers(len(self.special))
        self.special_number = {content: k for k, content in enumerate(self.special)}
        self.forget()

    def merged(self, symbols: list[int]) -> list[int]:
        """The encoding by its definition: merge the pair of least rank, leftmost first, until none is left."""
        out = list(symbols)
        while len(out) > 1:
            ranks = [self.merge.get(a << BITS | b, NO_MERGE) for a, b in zip(out, out[1:])]
            best = min(ranks)
            if best == NO_MERGE:
                break
            at = ranks.index(best)
            out[at : at + 2] = [self.product[best]]
        return out

    def _automaton(self, inner: dict[bytes, int], final: dict[bytes, int]) -> None:
        """For each string that starts a token: where each further byte leads, and the tokens that end there, longest first."""
        number, strings = {b"": 0}, [b""]
        for token in {**inner, **final}:
            for n in range(1, len(token) + 1):
                if token[:n] not in number:
                    number[token[:n]] = len(strings)
                    strings.append(token[:n])
        nowhere: dict[int, int] = {}
        self.step: list[dict[int, int]] = [nowhere] * len(strings)
        for at, string in enumerate(strings[1:], 1):
            before = number[string[:-1]]
            if self.step[before] is nowhere:
                self.step[before] = {}
            self.step[before][string[-1]] = at
        self.fall = array("i", [0]) * len(strings)
        self.inner: list[tuple[tuple[int, int], ...]] = [()] * len(strings)
        self.final: list[tuple[tuple[int, int], ...]] = [()] * len(strings)
        for at in sorted(range(1, len(strings)), key=lambda k: len(strings[k])):
            string = strings[at]
            fall = self._next(self.fall[number[string[:-1]]], string[-1]) if len(string) > 1 else 0
            self.fall[at] = fall
            for ends, tokens in ((self.inner, inner), (self.final, final)):
                own = tokens.get(string)
                ends[at] = ends[fall] if own is None else ((len(string), own), *ends[fall])
        self._arrays(np.fromiter(map(len, strings), np.int32, len(strings)), *({number[t]: i for t, i in tokens.items()} for tokens in (inner, final)))

    def _arrays(self, length: np.ndarray, inner: dict[int, int], final: dict[int, int]) -> None:
        """The automaton and the merges for many nodes at once.

        The states are there twice, once with the tokens inside words and once with those that
        end words.  ``ending`` leads to the longest token that ends at a state, as the state that
        spells it, and ``shorter`` from there to the next shorter one.
        """
        keys = np.array([at << 8 | byte for at, to in enumerate(self.step) for byte in to], np.int64)
        self.steps = _Table(keys, np.array([to for steps in self.step for to in steps.values()], np.int32))
        pairs = np.fromiter(self.merge.keys(), np.int64, len(self.merge))
        self.ranks = _Table(pairs, np.fromiter(self.merge.values(), np.int32, len(self.merge)))
        self.falls, self.lefts, self.rights, self.makes = (np.frombuffer(x, np.int32) for x in (self.fall, self.left, self.right, self.made))
        states = self.states = len(length)
        self.sizes, fall = np.tile(length, 2), np.concatenate([self.falls, self.falls + states])
        self.spells, self.ending = np.full(2 * states, -1, np.int32), np.zeros(2 * states, np.int32)
        for first, tokens in ((0, inner), (states, final)):
            self.spells[first + np.array([*tokens], np.int64)] = [*tokens.values()]
        for n in range(1, int(length.max()) + 1):
            at = np.flatnonzero(self.sizes == n)
            self.ending[at] = np.where(self.spells[at] >= 0, at, self.ending[fall[at]])
        self.shorter = self.ending[fall]

    def _next(self, at: int, byte: int) -> int:
        while True:
            to = self.step[at].get(byte)
            if to is not None:
                return to
            if not at:
                return 0
            at = self.fall[at]

    def fits(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are when their joined string is encoded.

        Merges are undone from the last one made backwards.  At each point the
        two tokens that face each other over the boundary lived until the next
        merge on either side; had they a merge of their own that came before, it
        would have been made.  On equal rank the pair further left comes first.
        """
        key = left << BITS | right
        known = self.pairs.get(key)
        if known is not None:
            return known
        if len(self.pairs) >= REMEMBER_PAIRS:
            self.pairs.clear()
        made, merge = self.made, self.merge
        until = NO_MERGE
        while True:
            if merge.get(left << BITS | right, NO_MERGE) < until:
                known = False
                break
            l, r = made[left], made[right]
            if l < 0 and r < 0:
                known = True
                break
            if l > r:
                until, left = l, self.right[left]
            else:
                until, right = r + 1, self.left[right]
        self.pairs[key] = known
        return known

    def stays(self, token: int) -> bool:
        """Whether a token's own string is encoded as that token."""
        known = int(self.whole[token])
        if known < 0:
            spelt = self.token[token].decode()
            body = spelt.removesuffix(END)
            known = self.whole[token] = self.merged([*(self.letter[c] for c in body[:-1]), self.letter[body[-1] + spelt[len(body) :]]]) == [token]
        return bool(known)

    def _walk(self, words: list[bytes]) -> Iterator[list[int]]:
        """The ids of sorted words, depth first."""
        # the state of each prefix of the word at hand: its last token, that token's length, its place in the automaton
        last, back, place = [-1], [0], [0]
        before, fits, inner, step = b"", self.fits, self.inner, self.step
        for word in words:
            length, shared = len(word), 0
            most = min(len(last) - 1, length - 1)
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], back[shared + 1 :], place[shared + 1 :]
            at = place[-1]
            for n in range(shared, length):
                to = step[at].get(word[n])
                at = self._next(at, word[n]) if to is None else to
                ended = n + 1 == length
                for size, token in self.final[at] if ended else inner[at]:
                    if fits(last[n + 1 - size], token) if size <= n else self.stays(token):
                        break
                else:
                    raise ValueError(f"no token ends {word[: n + 1]!r}")
                if not ended:
                    last.append(token)
                    back.append(size)
                    place.append(at)
            ids, n = [token], length - size
            while n:
                ids.append(last[n])
                n -= back[n]
            yield ids[::-1]
            before = word

    def _stay(self, tokens: np.ndarray) -> np.ndarray:
        """``stays`` for many tokens."""
        for token in np.unique(tokens[self.whole[tokens] < 0]).tolist():
            self.stays(token)
        return self.whole[tokens] > 0

    def _fit(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """``fits`` for many pairs; a slot remembers the last pair that came to it."""
        keys = left.astype(np.int64) << BITS | right
        slots = _slots(keys, PAIR_BITS)
        out = self.pair_fits[slots]
        todo = np.flatnonzero(self.pair_keys[slots] != keys)
        if not len(todo):
            return out
        new, back = np.unique(keys[todo], return_inverse=True)
        fit, open_ = np.zeros(len(new), bool), np.arange(len(new))
        left, right, until = new >> BITS, new & (1 << BITS) - 1, np.full(len(new), NO_MERGE)
        while len(open_):
            rank = self.ranks.get(left << BITS | right)
            apart = (rank < 0) | (rank >= until)
            l, r = self.makes[left], self.makes[right]
            letters = (l < 0) & (r < 0)
            fit[open_[apart & letters]] = True
            on = apart & ~letters
            open_, left, right, l, r = open_[on], left[on], right[on], l[on], r[on]
            later = l > r
            until = np.where(later, l, r + 1)
            left, right = np.where(later, self.rights[left], left), np.where(later, right, self.lefts[right])
        slots = _slots(new, PAIR_BITS)
        self.pair_keys[slots] = new
        self.pair_fits[slots] = fit[np.searchsorted(new, self.pair_keys[slots])]  # of pairs that share a slot one is there
        out[todo] = fit[back]
        return out

    def _go(self, place: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """``_next`` for many places."""
        out = self.steps.get(place.astype(np.int64) << 8 | byte)
        todo = np.flatnonzero(out < 0)
        place, byte = place[todo], byte[todo]
        while len(todo):
            on = place > 0
            out[todo[~on]] = 0
            todo, place, byte = todo[on], self.falls[place[on]], byte[on]
            to = self.steps.get(place.astype(np.int64) << 8 | byte)
            out[todo] = to
            on = to < 0
            todo, place, byte = todo[on], place[on], byte[on]
        return out

    def _states(self, at: np.ndarray, nodes: np.ndarray, n: int, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The last token of each prefix of n + 1 bytes, given by a word that starts with it, and that token's length."""
        token, size = np.empty(len(at), np.int32), np.empty(len(at), np.int32)
        todo, at = np.arange(len(at)), self.ending[at]
        while len(todo):
            own, long = self.spells[at], self.sizes[at]
            if own.min() < 0:
                raise ValueError(f"no token ends a prefix of {n + 1} bytes")
            begins = long > n
            ok = np.empty(len(todo), bool)
            ok[begins] = self._stay(own[begins])
            inside = ~begins
            ok[inside] = self._fit(last[n + 1 - long[inside], nodes[todo[inside]]], own[inside])
            token[todo[ok]], size[todo[ok]] = own[ok], long[ok]
            todo, at = todo[~ok], self.shorter[at[~ok]]
        return token, size

    def _levels(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of sorted words one after the other, and how many each has."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        deep = int(length.max())
        letters = np.ascontiguousarray(np.array(words, f"S{deep}").view(np.uint8).reshape(-1, deep).T)
        # the state of the prefixes of the level at hand and above, for each word: last token, its length; place in the automaton
        last, back, place = np.empty((deep, len(words)), np.int32), np.empty((deep, len(words)), np.uint8), np.zeros(len(words), np.int32)
        token, size = np.empty(len(words), np.int32), np.empty(len(words), np.int64)
        same = np.arange(len(words)) > 0  # whether a word starts as the one before it
        for n in range(deep):
            same[1:] &= letters[n, 1:] == letters[n, :-1]
            more = length > n + 1
            live, ended = np.flatnonzero(more), np.flatnonzero(length == n + 1)
            fresh = ~(same[live] & more[live - 1])
            nodes = np.concatenate([live[fresh], ended])
            inner = len(nodes) - len(ended)
            at = self._go(place[nodes], letters[n, nodes])
            kind = at.copy()
            kind[inner:] += self.states
            tokens, sizes = self._states(kind, nodes, n, last)
            token[ended], size[ended] = tokens[inner:], sizes[inner:]
            if inner:
                group = np.cumsum(fresh) - 1
                last[n + 1, live], back[n + 1, live], place[live] = tokens[group], sizes[group], at[group]
        steps, rest, count = [(np.arange(len(words)), token)], length - size, np.ones(len(words), np.int64)
        while len(on := np.flatnonzero(rest)):
            steps.append((on, last[rest[on], on]))
            count[on] += 1
            rest[on] -= back[rest[on], on]
        end, out = np.cumsum(count), np.empty(int(count.sum()), np.int32)
        for k, (on, tokens) in enumerate(steps):
            out[end[on] - 1 - k] = tokens
        return out, count

    def _encoded(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct sorted words one after the other, and how many each has."""
        flat, counts = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for first in range(0, len(words), WORDS):
            mine = words[first : first + WORDS]
            long = np.fromiter(map(len, mine), np.int64, len(mine)) > LEVELS
            short = [w for w in mine if len(w) <= LEVELS] if long.any() else mine
            out, count = self._levels(short) if short else (flat[0], counts[0])
            if long.any():
                walked = [np.array(ids, np.int32) for ids in self._walk([w for w in mine if len(w) > LEVELS])]
                every, start = np.empty(len(mine), np.int64), np.empty(len(mine), np.int64)
                every[~long], every[long] = count, [len(x) for x in walked]
                start[~long], start[long] = np.cumsum(count) - count, len(out) + np.cumsum(every[long]) - every[long]
                out, count = _spread(np.concatenate([out, *walked]), start, every), every
            flat.append(out)
            counts.append(count)
        return np.concatenate(flat), np.concatenate(counts)

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, list[int]]]:
        """(word, ids) of distinct words, in sorted order."""
        words = sorted(words)
        flat, counts = self._encoded(words)
        for word, end, count in zip(words, np.cumsum(counts).tolist(), counts.tolist()):
            yield word, flat[end - count : end].tolist()

    def _runs(self, part: str) -> list[str]:
        if not part.isascii():
            part = unicodedata.normalize("NFC", part).replace("Σ", "σ")  # letters are lowered one by one: no final sigma
        part = part.lower()
        if any(c in part for c in "\x1c\x1d\x1e\x1f"):  # white space to str.split() but not to the vocabulary file
            return [x for x in self.space.split(part) if x]
        return part.split()

    def _learn(self) -> None:
        """Find the ids of the runs that have a number but no ids yet."""
        known = len(self.ends) - len(self.special)
        new = islice(self.ids, known, None)
        words, parts = _Numbers(0), array("i")
        words["\n"] = 0  # ends a run
        while mine := list(islice(new, CUT)):
            parts.extend(map(words.__getitem__, self.cutter.findall("\n".join(mine) + "\n")))
        if not parts:
            return
        del words["\n"]
        ordered = sorted(words)
        place = np.fromiter(map(words.__getitem__, ordered), np.int64, len(ordered))
        flat, count = self._encoded([w.encode() for w in ordered])
        counts, starts = np.zeros(len(ordered) + 1, np.int64), np.zeros(len(ordered) + 1, np.int64)
        counts[place], starts[place] = count, np.cumsum(count) - count
        part = np.frombuffer(parts, np.int32)
        each = counts[part]
        ends = np.cumsum(each)[part == 0]
        self.flat = np.concatenate([self.flat, _spread(flat, starts[part], each)])
        self.ends = np.concatenate([self.ends, self.ends[-1:] + ends if len(self.ends) else ends])

    def forget(self) -> None:
        """Empty the memory of runs; workers serve other queries between tasks."""
        self.ids.clear()
        self.flat, self.ends = np.array([*self.special.values()], np.int32), np.arange(1, len(self.special) + 1)

    def decode(self, ids: bytes) -> bytes:
        """The text of little-endian 32-bit ids, in UTF-8; special tokens are spelt out and unknown ids left out."""
        numbers = np.frombuffer(ids, "<u4")
        if len(numbers) and int(numbers.max()) >= len(self.token):
            numbers = numbers[numbers < len(self.token)]
        return b" ".join([t for t in map(self.token.__getitem__, numbers.tolist()) if t is not None])

    def decode_batch(self, ids: pa.BinaryArray) -> pa.StringArray:
        """``decode`` for the rows of an array without nulls, of ids that the encoder made."""
        ends = np.frombuffer(ids.buffers()[1], np.int32)[ids.offset : ids.offset + len(ids) + 1]
        numbers = np.frombuffer(ids.buffers()[2] or b"", "<u4")[ends[0] // 4 : ends[-1] // 4]
        spelt = pa.array(self.token, pa.binary()).take(pa.array(numbers))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array((ends - ends[0]) // 4), spelt), b" ").cast(pa.string())

    def _parts(self, text: str | None) -> Iterator[list[str] | str]:
        """The runs of each stretch of a text and the special tokens between them."""
        text, at = text or "", 0
        for m in self.cut.finditer(text) if self.cut and "<" in text else ():
            yield self._runs(text[at : m.start()])
            yield m[0]
            at = m.end()
        yield self._runs(text[at:])

    def encode_batch(self, texts: list[str | None]) -> Iterator[bytes]:
        """For each text its ids as little-endian 32-bit numbers.

        Texts are kept as the numbers of their runs: the runs of all of them as lists would take ten times the texts' size.
        """
        runs, ends = array("i"), []
        for text in texts:
            for p in self._parts(text):
                if isinstance(p, str):
                    runs.append(self.special_number[p])
                else:
                    runs.extend(map(self.ids.__getitem__, p))
            ends.append(len(runs))
        self._learn()
        at, numbers = 0, np.frombuffer(runs, np.int32)
        starts, counts = np.concatenate([[0], self.ends[:-1]]), np.diff(self.ends, prepend=0)
        flat = self.flat
        if len(self.ids) > REMEMBER_RUNS:
            self.forget()
        for end in ends:
            mine = numbers[at:end]
            yield _spread(flat, starts[mine], counts[mine]).astype("<u4").tobytes()
            at = end


_loaded: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """The encoder of a file, loaded once in a process."""
    if path not in _loaded:
        _loaded[path] = TrieEncoder(path)
    return _loaded[path]


def _encode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            at = 0
            while at < b.num_rows:
                mine, size = [], 0
                while at + len(mine) < b.num_rows and size < FLUSH:
                    mine.append(texts[at + len(mine)].as_py())
                    size += len(mine[-1] or "")
                made = pa.array(list(e.encode_batch(mine)), pa.binary())
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(mine)), made, e.decode_batch(made)], names=["doc_id", "ids", "decoded"])
                at += len(mine)
        e.forget()

    return run


def _decode_batches(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            texts = [e.decode(x.as_py() or b"").decode() for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], names=["doc_id", "decoded"])

    return run


def decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """One row per row of ``encoded``: doc_id and the text that its ids (binary, as ``encode`` makes them) decode to; null ids decode to the empty text."""
    narrow = encoded.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(ids_col).cast("binary").alias("ids"))
    return narrow.mapInArrow(lean(_decode_batches(path)), "doc_id bigint, decoded string")


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids, decoded.

    ``ids`` holds the token ids as little-endian unsigned 32-bit numbers, and
    ``decoded`` is the text that those ids decode to.  ``path`` names the
    vocabulary file, which every worker must be able to open.
    """
    narrow = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    made = narrow.mapInArrow(lean(_encode_batches(path)), "doc_id bigint, ids binary, decoded string")
    return made.select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids", "decoded")
