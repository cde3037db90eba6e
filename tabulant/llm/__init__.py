"""Training-data operators: one module per operator, their registered queries and SQL in ``queries``.

Nothing outside this folder, ``tests/llm`` and ``corpus_pipeline.py`` imports
this subpackage, except the guarded import in ``__spark_entry__.py``.
"""

import sys

from pyspark import cloudpickle

# Functions that run in executors travel with the job, so executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
