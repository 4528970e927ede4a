"""Brute-force versions that several tests use."""

from test_dedup import brute_components, brute_fingerprint
from test_native import measures

__all__ = ["brute_fingerprint", "brute_groups_of", "measures"]


def brute_groups_of(prints):
    """The smallest id that links of 3 or fewer differing bits reach, by id."""
    edges = [(a, b) for k, (a, x) in enumerate(prints) for b, y in prints[k + 1 :] if (x ^ y).bit_count() <= 3]
    return brute_components([i for i, _ in prints], edges)
