"""surveylens — questionnaire analytics as Spark DataFrame operators.

Sub-packages: ``sources`` (readers/writers), ``functions`` (column
expressions, presets, distribution tails), ``operators`` (cleaning, bins,
crosstabs, descriptive statistics, geography, ANOVA, models), ``plans``
(the end-to-end survey run and the registered queries) and ``streaming``
(the row-wise cleaning applied to a stream).
"""

import sys as _sys

__version__ = "0.1.0"

# The one Python function that runs inside tasks (the vectorised p-value
# finisher) is shipped by value, so executors do not need this package
# installed (shipping it with --py-files works as well).
try:
    from pyspark import cloudpickle as _cloudpickle

    _cloudpickle.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # pragma: no cover - older cloudpickle without the registry
    pass
