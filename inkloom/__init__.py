"""Inkloom: cleaning, linking, structuring and auditing document corpora with Spark."""
