"""Review analytics as PySpark DataFrame transformations.

Every operator takes DataFrames and returns DataFrames.  Nothing is executed
until the caller runs an action, except where a docstring says otherwise.
"""

__version__ = "0.1.0"
