"""Tessera: Spark operators for time-stamped speech segments, signals, embeddings and transcripts."""
