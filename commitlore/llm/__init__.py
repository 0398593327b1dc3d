"""Operators for text corpora: mixing, language, toxicity, packing, scoring, chats, copies, contamination.

Nothing outside this folder imports it. Functions of these modules travel by value with their tasks, so
executors need no copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
