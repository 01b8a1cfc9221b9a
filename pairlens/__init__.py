"""Paired-experiment and text-corpus analytics as plain DataFrame-in, DataFrame-out operators on Spark."""
