"""Contrastive selection over knowledge graphs, on Spark."""
