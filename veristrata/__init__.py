"""Veristrata: evidence retrieval, claim assessment and corpus preparation as Spark plans."""
