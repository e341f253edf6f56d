"""Sources: files, recorded pages of REST services, webhooks, and incremental sync.

Readers travel to the executors by value, so a cluster needs no copy of the package on workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
