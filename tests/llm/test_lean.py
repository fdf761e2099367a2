"""``lean`` changes nothing about the batches."""

import pyarrow as pa
import pytest

from vecstrata.llm.lean import give_back, lean


def _batch(n: int) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"n": list(range(n))})


def test_all_batches_pass_in_order():
    def twice(batches):
        for b in batches:
            yield b
            yield b.slice(1)

    made = [b.num_rows for b in lean(twice)(iter([_batch(3), _batch(1), _batch(0)]))]
    assert made == [3, 2, 1, 0, 0, 0]


def test_no_batches_and_output_after_the_last_one():
    def counted(batches):
        yield _batch(sum(b.num_rows for b in batches))

    assert [b.num_rows for b in lean(counted)(iter([]))] == [0]
    assert [b.num_rows for b in lean(counted)(iter([_batch(2), _batch(3)]))] == [5]


def test_errors_come_through():
    def broken(batches):
        next(batches)
        raise ValueError("broken")
        yield

    with pytest.raises(ValueError, match="broken"):
        list(lean(broken)(iter([_batch(1)])))


def test_giving_back_twice_is_harmless():
    give_back()
    give_back()
