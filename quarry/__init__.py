"""quarry: Spark-native data work around a retrieval corpus.

Everything is DataFrame in, DataFrame out.  Sub-packages:

* ``sources``   – table and file scans (pages, documents, staged files, links)
* ``functions`` – column expressions (text cleaning, URLs, vectors, prompts, JSON)
* ``operators`` – multi-step operators (chunking, embedding, index upkeep,
  top-k search, model calls, evaluation, HTML to text)
* ``plans``     – end-to-end jobs composed from the operators
* ``streaming`` – incremental file ingest with Structured Streaming
"""

__version__ = "0.1.0"
