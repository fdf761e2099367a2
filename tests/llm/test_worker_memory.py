"""What workers hold: the encoder's tables, the runs of a batch, copies made by filters."""

import sys
import tracemalloc

import pyarrow as pa

from vecstrata.llm import decontaminate, quality
from vecstrata.llm.bpe import TrieEncoder
from vecstrata.llm.queries import word_vocabulary


class Holds:
    """A broadcast value that keeps texts that start with k."""

    @property
    def value(self):
        return self

    def judge(self, text):
        return 0.0, 0.0, text[:1] == b"k"

    def search(self, texts):
        return [(k, 0) for k, t in enumerate(texts) if t[:1] != b"k"]


def size(x, seen):
    if id(x) in seen:
        return 0
    seen.add(id(x))
    inside = [*x, *x.values()] if isinstance(x, dict) else x if isinstance(x, list | tuple) else ()
    return sys.getsizeof(x) + sum(size(y, seen) for y in inside)


def test_tables_are_small():
    assert size(vars(TrieEncoder(word_vocabulary())), set()) < 40e6


def test_a_batch_does_not_hold_all_its_runs():
    own = TrieEncoder(word_vocabulary())
    texts = ["some words that are seen again " * 30] * 1000
    want = list(own.encode_batch(texts[:1]))
    tracemalloc.start()
    assert all([x] == want for x in own.encode_batch(texts))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 4e6


def test_filters_pass_on_small_batches():
    texts = [f"{'k' if k % 3 else 'x'} {k}" for k in range(4321)]
    b = pa.RecordBatch.from_pydict({"n": list(range(4321)), "text": texts})
    for run in (quality._keep_batches(Holds(), 1), decontaminate._clean_batches(Holds(), 1)):
        made = list(run(iter([b, b.slice(0, 0)])))
        assert [t for x in made for t in x.column(1).to_pylist()] == [t for t in texts if t[0] == "k"]
        assert max(x.num_rows for x in made) <= 1000
