"""weftline: a Spark-first engine for claim-level fact checking data.

Sub-packages
------------
functions   column expressions and Arrow-batched functions
operators   DataFrame -> DataFrame operators
sources     readers, writers and connectors
plans       composed pipelines and the registered queries with their SQL
streaming   Structured Streaming wrappers
llm         training-data operators; optional, nothing else imports it
"""

__version__ = "0.1.0"
