"""Operators of a training-data pipeline; nothing else in factweave imports this subpackage."""
