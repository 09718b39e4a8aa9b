"""Incremental work: batches of models that survive an interruption."""
