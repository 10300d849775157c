"""Names and constants shared by every module."""

from __future__ import annotations

# They must match the published table layout and estimator.
NULL_TOKEN = "~"            # category that stands for a missing value
CLASS_PARENT = "KDB$CLASS"  # parent marker on the label row of a structure table
PROB_FLOOR = 1e-75          # smallest probability taken into a logarithm
DEFAULT_K = 2

# Pseudo attribute number of the class-prior rows inside a count table.
PRIOR_NUM = -1

# Ties in information measures are broken after rounding to this many places.
RANK_DIGITS = 12


def parent_columns(k: int) -> list[str]:
    """Names of the parent value columns of a k-dependence model table."""
    return [f"parent{i}" for i in range(1, k + 1)]
