import random
import time

import numpy as np
import pytest

from dualview.functions import crystal


def cell(a, b, c, alpha, beta, gamma):
    ca, cb, cg = (np.cos(np.radians(x)) for x in (alpha, beta, gamma))
    sg = np.sin(np.radians(gamma))
    x = (ca - cb * cg) / sg
    return np.array([[a, 0, 0], [b * cg, b * sg, 0], [c * cb, c * x, c * np.sqrt(1 - cb**2 - x**2)]])


CENTRED = np.array([[0.5, 0.5, -0.5], [-0.5, 0.5, 0.5], [0.5, -0.5, 0.5]])
FACES = np.array([[0, 0.5, 0.5], [0.5, 0, 0.5], [0.5, 0.5, 0]])
BASE = np.array([[0.5, 0.5, 0], [-0.5, 0.5, 0], [0, 0, 1.0]])
CASES = [
    ("cubic", cell(4, 4, 4, 90, 90, 90)), ("cubic", CENTRED @ cell(4, 4, 4, 90, 90, 90)), ("cubic", FACES @ cell(4, 4, 4, 90, 90, 90)), ("tetragonal", cell(4, 4, 5.3, 90, 90, 90)), ("tetragonal", CENTRED @ cell(4, 4, 9.1, 90, 90, 90)),
    ("orthorhombic", cell(3, 4.1, 5.3, 90, 90, 90)), ("orthorhombic", FACES @ cell(3, 4.1, 5.3, 90, 90, 90)), ("orthorhombic", BASE @ cell(3, 4.1, 5.3, 90, 90, 90)), ("hexagonal", cell(3, 3, 5, 90, 90, 120)), ("trigonal", cell(4, 4, 4, 70, 70, 70)),
    ("monoclinic", cell(3, 4.1, 5.3, 90, 103, 90)), ("monoclinic", BASE @ cell(3, 4.1, 5.3, 90, 103, 90)), ("triclinic", cell(3, 4.1, 5.3, 75, 83, 101)),
]


@pytest.mark.parametrize("name,rows", CASES)
def test_systems_in_any_setting(name, rows):
    r = random.Random(1)
    assert crystal.system_of(rows) == name
    for _ in range(12):
        moved = np.array(rows)
        for _ in range(5):
            i, j = r.sample(range(3), 2)
            moved[i] = moved[i] + r.choice([-2, -1, 1]) * moved[j]
        turn, _ = np.linalg.qr(np.random.default_rng(r.randint(0, 99)).normal(size=(3, 3)))
        assert crystal.system_of(moved @ turn) == name
    assert crystal.system_of(rows * (1 + 1e-5)) == name


def test_failure_is_a_category():
    for bad in (None, [], [[1, 0, 0]], [[1, 0, 0], [0, 1, 0], [1, 1, 0]], [[1, 0, 0], [0, float("nan"), 0], [0, 0, 1]], "abc", [[1, 0, 0], None, [0, 0, 1]]):
        assert crystal.system_of(bad) == crystal.UNKNOWN


def test_many_cells_take_little_time_each():
    r = np.random.default_rng(4)
    rows = [x * s for s in r.uniform(0.5, 2, 1000) for _, x in CASES]
    began = time.process_time()
    assert crystal.systems_of([*rows, None]) == [*[name for name, _ in CASES] * 1000, crystal.UNKNOWN]
    assert time.process_time() - began < 6
