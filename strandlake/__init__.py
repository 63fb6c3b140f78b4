"""Strandlake: a Spark-native engine for append-only, branchable, time-travelling records."""
