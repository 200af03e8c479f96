"""Samplewright: multichannel time-series analytics as Spark DataFrame plans."""
