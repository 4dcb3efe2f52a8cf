"""framemill: episodic and text data processing on Spark DataFrames.

Sub-packages: ``sources`` (readers, sinks, catalogues), ``operators`` (relational
and time-series operators), ``functions`` (column expressions), ``streaming``
(Structured Streaming variants), ``plans`` (the registered queries and their SQL)
and ``llm`` (optional operators for language-model corpora; nothing outside that
sub-package imports it).
"""

__version__ = "0.1.0"
