"""staysignal — customer-retention analytics expressed as Spark DataFrame plans.

Every public operator is a lazy ``DataFrame -> DataFrame`` (or ``Column``)
function built from Spark's own expressions, so Catalyst plans the work and
the same code runs from a laptop sample to a cluster.
"""

__version__ = "0.1.0"
