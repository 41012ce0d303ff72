"""Shared plan building blocks: folds, staging, prefix sums."""
