"""framesift: Spark-native analytics over media evidence (ingest, forensics, scoring, job ledger)."""
