"""Operators for preparing training data at scale.

Nothing else in the library imports this subpackage.  Each operator module has
a general interface over DataFrames; ``queries`` applies the operators to
the driver's tables and is what ``__spark_entry__`` registers.
"""
