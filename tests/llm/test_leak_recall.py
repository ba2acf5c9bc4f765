"""Leaks at the limit of edits, by the length of the item."""

import random

import pytest

from medspark.llm import decontamination


def edited(item, edits, rng):
    out = list(item)
    for at in sorted(rng.sample(range(len(item)), edits), reverse=True):
        new = b"new%d" % rng.randrange(10**9)
        out[at:at + 1] = rng.choice([[new, item[at]], [], [new]])
    return out


def least_edits(item, text):
    """Plain table of distances: the best span anywhere in the text."""
    line = list(range(len(item) + 1))
    best = line[-1]
    for word in text:
        above, line[0] = line[:], 0
        for i, expected in enumerate(item, 1):
            line[i] = min(above[i - 1] + (word != expected), above[i] + 1, line[i - 1] + 1)
        best = min(best, line[-1])
    return best


def test_bits_give_the_distances_of_the_table():
    rng = random.Random(4)
    for _ in range(300):
        item = [b"%d" % rng.randrange(6) for _ in range(rng.randint(1, 80))]
        text = edited(item, rng.randint(0, len(item) // 3), rng) + [b"%d" % rng.randrange(6) for _ in range(9)]
        most = rng.randint(0, len(item))
        best, line = (len(item), 0), list(range(len(item) + 1))
        for end, word in enumerate(text[:len(item) + most], 1):
            above, line[0] = line[:], end
            for i, expected in enumerate(item, 1):
                line[i] = min(above[i - 1] + (word != expected), above[i] + 1, line[i - 1] + 1)
            best = min(best, (line[-1], end), key=lambda b: b[0])
        assert decontamination.edits_at(item, text, 0, most) == (best if best[0] <= most else None)


@pytest.mark.parametrize("n", [16, 20, 42, 64, 100, 200, 400])
def test_items_are_found_at_the_limit_of_edits(n):
    rng, found, trials = random.Random(n), 0, 100 if n <= 100 else 40
    for trial in range(trials):
        item = [b"w%d" % rng.randrange(10**9) for _ in range(n)]
        text = [b"h%d" % i for i in range(25)] + edited(item, n // 5, rng) + [b"t%d" % i for i in range(25)]
        got = decontamination.Index([(7, b" ".join(item))], seed=trial).matches(text)
        assert all(m.edits >= least_edits(item, text) for m in got)
        found += bool(got)
    print(n, decontamination.plan(n), found / trials)
    assert found >= 0.99 * trials
