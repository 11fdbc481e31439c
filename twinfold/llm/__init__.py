"""Training-data operators.

Nothing else in the library imports this subpackage; it only needs PySpark,
numpy, pyarrow and the standard library (plus ``regex`` for byte-level BPE).
"""
