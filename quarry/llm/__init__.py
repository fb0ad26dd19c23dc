"""Training-data operators: each module is one operator on DataFrames.

Nothing else in the library imports this subpackage; ``queries`` registers
the operators' queries and ``__spark_entry__`` adds them when it exists.
"""
