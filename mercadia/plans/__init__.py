"""Shared plans: the facts, customer roll-ups, and the batch pipelines."""
