"""Training-data operators: ten document-level jobs and their registered queries.

Nothing outside this subpackage imports it.  Task functions travel with their
code, so executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
