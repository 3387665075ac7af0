"""Stellwerk: a PySpark engine for job-posting captures, identity, scoring and digests."""
