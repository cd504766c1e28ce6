"""quotelens: quote analytics and pricing models as Spark jobs.

Every public function takes and returns DataFrames. Sub-packages:

* ``sources``   -- table loaders, the ``quotes`` view, sinks
* ``functions`` -- column expressions (features, fuzzy score, p-values)
* ``operators`` -- DataFrame -> DataFrame operators (quality, profile,
  models, cross-validation, bias, bands, lenses, workflow)
* ``plans``     -- the query catalog and the DuckDB oracle SQL
* ``streaming`` -- Structured Streaming jobs (lifecycle, drift)
"""

import sys

from pyspark import cloudpickle

# functions that run in tasks travel by value: executors need no copy of the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
