"""citeloom: dataset-usage analytics over scholarly records, on PySpark.

``sources``    readers, writers and the session's shared folder
``functions``  column functions (text, json, urls, similarity, scores)
``operators``  DataFrame -> DataFrame operators
``streaming``  incremental sync on Structured Streaming
``plans``      named queries over the test tables, with their SQL
``llm``        training-data operators; optional, imported by nothing else here
"""

__version__ = "0.1.0"
