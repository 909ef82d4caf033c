"""grantlake: a lake of public funding and compliance pages, built and queried with Spark."""

import sys

from pyspark import cloudpickle

# Functions sent to Arrow tasks carry their code with them, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
