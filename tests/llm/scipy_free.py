import numpy as np


def chi_square_ok(seen, want, sigmas=4.5):
    """Whether counts are as near as expected, by the normal limit of chi square."""
    x = (((np.asarray(seen) - want) ** 2) / want).sum()
    k = len(want) - 1
    return x < k + sigmas * (2 * k) ** 0.5 + 4
