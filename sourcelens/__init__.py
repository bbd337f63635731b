"""sourcelens — source-corpus analytics as Spark DataFrame jobs.

Entry points:

* ``sources.corpus.scan_corpus`` / ``corpus_from_table`` — build the ``files`` corpus;
* ``operators.extract.analyze`` — per-file symbols and metrics in one narrow pass;
* ``operators.stats`` / ``deps`` / ``rank`` / ``docs`` — per-repository reports;
* ``operators.retrieval`` — TF-IDF index, search and answers;
* ``plans.reports.write_reports`` — the batch job writing every report table;
* ``streaming.incremental.ingest_stream`` — incremental ingest of new files.
"""

__version__ = "0.1.0"
