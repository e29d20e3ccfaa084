"""Operators for large training-text corpora.

Nothing else in the library imports this package.  Every operator maps a
DataFrame to a DataFrame and is lazy except where its docstring says that an
intermediate table is written to the folder in ``spark.checkpoint.dir``.
"""
