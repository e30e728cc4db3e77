"""Training-data operators: one module per operator, each with its own method.

Nothing else in the library imports this package; ``__spark_entry__`` adds
its queries only when it can be imported.
"""
