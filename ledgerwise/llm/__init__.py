"""Operators for training-data pipelines over a table of documents.

Functions of this subpackage that run inside tasks travel with the task, so executors need not have it installed.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
