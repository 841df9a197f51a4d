"""Presenting batches one after another."""
