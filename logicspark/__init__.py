"""Logic-capture analytics as Spark tables and streams."""

import sys

from pyspark import cloudpickle

from logicspark.schemas import (
    CsPolarity,
    DisplayMode,
    SpiMode,
    StrobeMode,
    require_columns,
)

__all__ = ["CsPolarity", "DisplayMode", "SpiMode", "StrobeMode", "require_columns"]

# task functions travel with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
