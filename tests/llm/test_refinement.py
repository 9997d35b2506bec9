"""The work of a refinement, and the numbers that it goes by."""

import numpy as np

from quarry.llm import hashing, suffix_array_dedup


def test_numbered():
    """Equal elements alone have the same number, also where the leading bits of their mixes are alike."""
    rng = np.random.default_rng(5)
    x = rng.integers(0, 2**64, 1000, dtype=np.uint64)
    for some in (x[:0], x[:1], np.concatenate((x, x[::3], x[:1])), np.arange(1 << 16, dtype=np.uint64) % 7):
        number, count = hashing.numbered(some)
        every, inverse, counts = np.unique(some, return_inverse=True, return_counts=True)
        assert len(set(zip(number.tolist(), inverse.tolist(), strict=True))) == len(every) == len(count)
        assert (count[number] == counts[inverse]).all()


def test_numbered_where_leading_bits_are_alike(monkeypatch):
    monkeypatch.setattr(hashing, "mix", lambda x: x * np.uint64(0))
    number, count = hashing.numbered(np.array([5, 9, 5, 7], np.uint64))
    assert sorted(count.tolist()) == [1, 1, 2] and number[0] == number[2] and len(set(number.tolist())) == 3


def test_windows_alone_arent_refined(monkeypatch):
    """After the first buckets only what windows left together reach is sorted: not every suffix whose first bytes are repeated."""
    rng = np.random.default_rng(3)
    cells = [rng.integers(0, 256, 60, dtype=np.uint8) for _ in range(200)]
    for c in cells:
        c[52:] = 7  # eight bytes alike in every cell, which no window begins with
    cells += [cells[0]]
    units, ends = np.concatenate(cells), np.cumsum([60] * 201)
    sizes, plain = [], hashing.numbered
    monkeypatch.setattr(suffix_array_dedup, "numbered", lambda x: sizes.append(len(x)) or plain(x))
    got = suffix_array_dedup.refine(units, ends - 60, ends, 50).tolist()
    assert got[:11] == got[-11:] and len(set(got)) == 200 * 11
    assert max(sizes[1:]) <= 2 * 60
