"""colophon: scholarly-metadata processing on Apache Spark.

Sub-packages: ``functions`` (column expressions), ``operators`` (DataFrame to
DataFrame), ``sources`` (readers and writers), ``plans`` (composed pipelines),
``streaming``, ``queries`` (the named queries with their SQL) and the optional
``llm`` (training-data operators; nothing else imports it).
"""

__version__ = "0.1.0"
