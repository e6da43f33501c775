"""Mobility analytics as DataFrame operators on Spark."""
