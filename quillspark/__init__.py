"""quillspark: a PySpark-native library of data-construction, profiling and evaluation operators."""

__version__ = "0.1.0"
