"""Nearest segments without comparing all pairs."""

import numpy as np

from incidence.operators import snapping


def test_nearest_is_that_of_all_pairs_and_far_fewer_are_compared():
    rng = np.random.default_rng(4)
    points = rng.random((2, 3000)) ** 3 * 400
    points[:, :200] = points[:, :1]  # one place, many points
    start = rng.random((2, 800)) * 400
    segments = np.concatenate([start, rng.normal(0, 150, (2, 800))])
    segments[2:, :40] = 0  # single places
    segments[:, 41] = segments[:, 40]  # equal ones: the first counts
    compared = []

    def exact(p, e):
        compared.append(len(p) * len(e))
        return snapping._along(points[0, p][:, None], points[1, p][:, None], segments[:, e][:, None, :])[0]

    for reach in (50.0, 0.5):
        compared.clear()
        all_pairs = snapping._along(points[0][:, None], points[1][:, None], segments[:, None, :])[0]
        want = {(i, int(k)) for i, k in enumerate(all_pairs.argmin(axis=1)) if all_pairs[i, k] <= reach}
        found = set(zip(*(x.tolist() for x in snapping.nearest(points, segments, reach, exact)), strict=True))
        assert found == want and want and sum(compared) < 3000 * 800 / 10
    assert not len(snapping.nearest(points, segments[:, :0], 50.0, exact)[0]) and not len(snapping.nearest(points[:, :0], segments, 50.0, exact)[0])
