"""Curation of large article and event flows on Spark."""
