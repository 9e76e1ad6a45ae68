"""The knapsack of the mix holds a few bytes a sum, however many lengths there are."""

import tracemalloc

from rostrum.llm.mixing import _fill


def test_many_lengths_hold_no_sums_of_their_own():
    size = list(range(1, 1201))
    tracemalloc.start()
    add, made = _fill(size, [1] * len(size), sum(size))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert made == sum(size) and add == [1] * len(size)
    assert peak < 12 * sum(size)
