"""civiclens: spatial analysis of public comments on planning applications, on Spark.

Every operator takes DataFrames and returns a lazy DataFrame; per-row work is
built-in Spark SQL expressions, so the plans stay inside whole-stage codegen.
"""

__version__ = "0.1.0"
