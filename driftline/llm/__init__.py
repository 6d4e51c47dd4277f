"""Training-data operators: filters, deduplication, decontamination, privacy, mixing. Nothing else imports this folder.

Functions of this folder travel to the executors by value, so that the package need not be installed there.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
