"""Documents of more units than the operator once took."""

import numpy as np

from lodestrata.operators import segment


def test_many_units():
    n = 20_001
    starts, cost, _ = segment.solve(np.ones((n, 1)), np.ones(n), np.zeros(n), float(n))
    assert starts == [0] and abs(cost) < 1e-6  # equal units, aimed at one segment: nothing is cheaper
