"""hazardlens: incident-risk analytics as Spark DataFrame operators.

Every public operator takes DataFrames and returns a DataFrame built from
stock Spark expressions, so Catalyst sees (and optimises) the whole plan.
"""

__version__ = "0.1.0"
