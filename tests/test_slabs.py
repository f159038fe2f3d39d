"""Groups of matches by their place, and set bits by their place, against counting them out."""

import numpy as np

from hearthspark.operators import slabs


def test_set_bits_are_found_by_their_place():
    drawn = np.random.default_rng(1)
    masks = [drawn.random(200) < share for share in (0.02, 0.5, 1.0)] + [np.zeros(200, dtype=bool)]
    laid = slabs.Laid.__new__(slabs.Laid)
    laid.words = 4
    counted = slabs.Counted(np.stack([laid.bits(m) for m in masks]), 200)
    for i, mask in enumerate(masks):
        at = np.nonzero(mask)[0]
        assert counted.total[i] == len(at)
        assert (counted.nth(np.full(len(at), i), np.arange(1, len(at) + 1)) == at).all()
    for end in (0, 1, 63, 64, 65, 128, 199, 200):
        assert (counted.before(np.full(len(masks), end)) == [m[:end].sum() for m in masks]).all()


def test_groups_hold_every_match_once_and_end_at_the_page():
    totals, upto = np.array([0, 1, 2, 5, 40, 100_000, 7]), np.array([5, 5, 1, 5, 30, 3, 1000])
    which, first, last = slabs.ladder(totals, upto)
    for i, (total, most) in enumerate(zip(totals, upto, strict=True)):
        groups = list(zip(first[which == i], last[which == i], strict=True))
        assert [p for a, b in groups for p in (a, b)] == sorted(p for a, b in groups for p in (a, b))
        assert sum(b - a + 1 for a, b in groups) == total
        assert total <= most or any(b == most for _, b in groups)
        for seen in range(0, min(total, 200) + 1):
            ends = [0, *(b for _, b in groups if b <= seen)]
            assert slabs.passed_places(np.array([total]), np.array([most]), np.array([seen]))[0] == ends[-1]
