"""trajspark: trajectory and evaluation data work on Spark DataFrames.

Every public function takes and returns DataFrames (or column expressions);
nothing is collected to the driver except one-row statistics, per-partition
counts and loop-termination counts.
"""

__version__ = "0.1.0"
