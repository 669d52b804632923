"""brakta: a PySpark-native engine for finding, masking and measuring personal data in text.

Operators take DataFrames and return DataFrames; nothing here starts a job
unless its docstring says so.
"""

__version__ = "0.1.0"
