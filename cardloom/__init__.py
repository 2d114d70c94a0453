"""Spend and offer analytics as Spark DataFrame operators."""
