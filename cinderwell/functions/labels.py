"""Label, lookup and formatting expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

# Display names of the six classifier analytes.
DISPLAY_NAMES = {
    "Oxygen, Dissolved, Total": "Dissolved Oxygen",
    "Turbidity, Total": "Turbidity",
    "Nitrogen, Total, Total": "Nitrogen",
    "pH": "pH",
    "Phosphorus as P, Total": "Phosphorus",
    "Total Organic Carbon, Total": "Total Organic Carbon",
}

# Direction spellings used by the three result families.
UP_DOWN_WORDS = ("↑ increased", "↓ decreased")
UP_DOWN_ARROWS = ("↑", "↓")
UP_DOWN_VERBS = ("↑ increases", "↓ decreases")

def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def short_label(c) -> Column:
    """The text before the first comma."""
    return F.substring_index(_c(c), ",", 1)


def short_label_py(name: str) -> str:
    return name.split(",")[0]


def lookup(c, mapping: dict, default=None) -> Column:
    """Dictionary lookup as a literal map (no join, no shuffle)."""
    m = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    out = m[_c(c)]
    return out if default is None else F.coalesce(out, F.lit(default))


def direction(c, words=UP_DOWN_ARROWS) -> Column:
    """Strictly positive is 'up'; zero, negative and NULL are 'down'."""
    up, down = words
    return F.when(_c(c) > 0, F.lit(up)).otherwise(F.lit(down))
