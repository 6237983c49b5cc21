"""Properties of the pure parts."""

from hypothesis import given, settings
from hypothesis import strategies as st

from ledgerloom.operators import blocks, chunking
from ledgerloom.streaming.rates import admit

SIZES = st.fixed_dictionaries({s: st.lists(st.integers(0, 50), max_size=30) for s in chunking.ORDER})


@settings(max_examples=200, deadline=None)
@given(SIZES, st.integers(1, 10), st.integers(0, 6))
def test_chunks_place_each_line_once(sizes, n, overlap):
    total = sum(map(sum, sizes.values()))
    placed = chunking.fill_chunks(sizes, total, n, overlap)
    own = sorted((s, p) for _, s, p, again in placed if not again)
    assert own == sorted((s, p) for s, v in sizes.items() for p in range(len(v)))
    assert all(0 <= c < n for c, *_ in placed)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 300), max_size=60), st.integers(1, 5), st.integers(1, 60))
def test_no_window_admits_more_than_the_limit(times, limit, period):
    from collections import deque

    state: deque[int] = deque()
    ok = [t for t in sorted(times) if admit(state, t, limit, period)]
    assert all(sum(t - period < x <= t for x in ok) <= limit for t in ok)


LINES = st.lists(st.sampled_from(["01-05-2020", "UPI", "500.00", "1,300.00", "Page 1 of 2", "", "02/05/2020 500.00", "x 9", "SALARY DR"]), max_size=40)


@settings(max_examples=300, deadline=None)
@given(LINES)
def test_blocks_come_from_date_lines(lines):
    found = blocks.parse_lines(lines)
    assert len(found) <= sum(blocks.Line(x).date is not None for x in lines)
    assert all(b.narration is None or b.narration.strip() == b.narration for b in found)
    assert all(b.deposit is None or b.withdrawal is None for b in found if b.balance is None)
