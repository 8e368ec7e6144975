"""tripleloom: a PySpark-native engine for knowledge-graph question-answering data.

Everything is a ``DataFrame -> DataFrame`` or ``Column -> Column`` function.  The
subpackage ``llm`` holds the training-data operators on text and is optional: nothing
else in the library imports it.
"""

__version__ = "0.1.0"
