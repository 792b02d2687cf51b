"""Retrieval and run analytics on Spark DataFrames.

Every public function takes DataFrames and returns DataFrames; the sub-packages are

* ``sources``      readers for corpora, questions, embeddings, log and metric files
* ``functions``    column expressions (vector maths, text, units, clocks)
* ``operators``    chunking, embedding, search, indexes, reranking, prompts, scoring, telemetry
* ``collections``  named vector collections kept as versioned parquet tables
* ``plans``        ingest, question answering and run reports built from the operators
* ``streaming``    Structured Streaming jobs over the same tables
"""
