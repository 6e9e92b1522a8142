"""Operators and queries of a training-data pipeline, as Spark jobs.

The code that runs inside tasks travels with them by value, so that the executors need not have the
package installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
