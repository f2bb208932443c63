"""Prompt-stability analytics on Spark."""
