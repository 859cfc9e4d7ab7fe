"""The cheapest sequence with room is found however many cheaper ones have none."""

import random

import pytest

from tracklake.llm import packing


def plain(lengths, capacity, linear, quadratic):
    """assign() with a search through all sequences for each piece."""
    cost = lambda n: linear * n + quadratic * n * n
    pieces, rest, n_seq = [], [], 0
    for d, n in enumerate(lengths):
        for start in range(0, n - n % capacity, capacity):
            pieces.append((d, start, capacity, n_seq, 0))
            n_seq += 1
        if n % capacity:
            rest.append((n % capacity, d, n - n % capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    total = sum(x[0] for x in rest)
    room = [capacity] * (total // capacity) + [1 << b for b in range(capacity.bit_length() - 1, -1, -1) if total % capacity >> b & 1]
    limit, spent, late = list(room), [cost(capacity - r) for r in room], []
    for n, d, start in rest:
        fits = [(spent[i], i) for i, r in enumerate(room) if r >= n]
        if not fits:
            late.append((n, d, start))
            continue
        _, i = min(fits)
        pieces.append((d, start, n, n_seq + i, limit[i] - room[i]))
        room[i] -= n
        spent[i] += cost(n)
    return pieces, late


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_only_what_fits_nowhere_whole_is_cut(seed):
    rng = random.Random(seed)
    lengths = [max(1, int(rng.lognormvariate(5.5, 1.1))) for _ in range(1_500)] if seed < 3 else [1, 2048, 4096, 5000, 1]
    expected, late = plain(lengths, 2048, 1.0, 1 / 2048)
    got = packing.assign(lengths, 2048, 1.0, 1 / 2048)
    assert got[: len(expected)] == expected
    cut = got[len(expected) :]
    assert {(d, start) for _, d, start in late} <= {(d, start) for d, start, *_ in cut} and sum(x[2] for x in cut) == sum(x[0] for x in late)
    # every token once, no sequence over its capacity
    at = {}
    for d, start, n, _, _ in sorted(got):
        assert start == at.get(d, 0)
        at[d] = start + n
    assert [at[d] for d in range(len(lengths))] == lengths
    fill = {}
    for _, _, n, s, _ in got:
        fill[s] = fill.get(s, 0) + n
    assert max(fill.values()) <= 2048
