"""Operators on texts and near-identical records for training data; nothing outside imports this package."""
