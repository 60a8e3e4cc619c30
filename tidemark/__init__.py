"""Tidemark: channel-intelligence analytics as Spark DataFrame functions."""
