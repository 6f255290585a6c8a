"""Event-listing catalogue engine on PySpark: ingest, classify, merge, store and query listings."""
