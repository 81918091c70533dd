"""Signed co-presence graph analytics on PySpark."""
