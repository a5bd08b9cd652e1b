"""Funding-offer catalogue built from Spark DataFrame operators."""
