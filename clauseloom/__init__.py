"""Clauseloom: tender-document analytics as Spark jobs (DataFrame in, DataFrame out)."""
