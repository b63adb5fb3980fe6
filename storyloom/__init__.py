"""storyloom: story analytics and corpus preparation as Spark DataFrame operators.

Functions that run on executors are pickled by value, so a job needs no copy of this
package on the workers' import path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
