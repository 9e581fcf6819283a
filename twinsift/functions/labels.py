"""The review labels and their meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The label vocabulary stored in feedback files.
LABELS = ("duplicate", "near-duplicate/harmonizable", "different", "needs-review")
UNLABELED = "unlabeled"
USABLE = ("duplicate", "near-duplicate/harmonizable", "different")
SAME = ("duplicate", "near-duplicate/harmonizable")


def is_usable(label: Column) -> Column:
    """A reviewer decided; needs-review is left out."""
    return label.isin(*USABLE)


def target(label: Column) -> Column:
    """1 for a pair to be merged, 0 for a different one."""
    return F.when(label.isin(*SAME), F.lit(1)).otherwise(F.lit(0))
