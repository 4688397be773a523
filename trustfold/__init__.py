"""trustfold: behaviour-log labelling, outlier consensus and reputation replay on Spark.

Every public function takes and returns Spark DataFrames.  Nothing is collected
to the driver except bounded statistics (a handful of numbers per column).
"""

from trustfold.params import Scenario, scenario

__all__ = ["Scenario", "scenario"]
