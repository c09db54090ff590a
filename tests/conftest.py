import os
import sys

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabwise.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    s = local_session(cores=4, shuffle_partitions=4, app="tabwise-tests")
    yield s
    s.stop()


def sample_orchard(seed: int = 7, n: int = 60):
    """A made table of trees: one text column, two categories, seven numbers and a Yes/No last column."""
    rng = np.random.default_rng(seed)
    soils, slopes = ["chalk", "clay", "loam", "peat"], ["east", "flat", "north", "south", "west"]
    rows = []
    for i in range(n):
        rings = int(rng.integers(2, 41))
        height = round(1.5 + 0.2 * rings + float(rng.normal(0, 0.4)), 2)
        pests = int(rng.integers(0, 9))
        vigour = round(float(np.clip(9 - 0.7 * pests + rng.normal(0, 0.6), 0, 10)), 1)
        rows.append((f"tree-{i:04d}", rings, height, soils[i % 4], slopes[int(rng.integers(0, 5))], int(rng.integers(50, 900)),
                     int(rng.integers(1, 30)), float(rng.integers(10, 90)) / 4, pests, vigour, "Yes" if vigour > 5 else "No"))
    schema = ("tag string, rings int, height double, soil string, slope string, leaves int, visits int, water double, "
              "pests int, vigour double, fruiting string")
    return rows, schema
