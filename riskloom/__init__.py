"""riskloom — motor-insurance pricing analytics as Spark jobs.

Every operator is a ``DataFrame -> DataFrame`` function (or a function that
returns a small, bounded result such as a fitted model).  Nothing passes rows
through the driver; the driver only ever holds bounded things — cut points,
margins, coefficients, tree nodes, metrics.
"""

__version__ = "0.1.0"
