"""folioscan: a Spark-first engine for tagged document corpora.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and parsers), ``plans`` (composed pipelines),
``streaming`` (incremental sinks), ``queries`` (named queries with SQL) and,
optional, ``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
