"""Operators that a training-data pipeline adds to the engine; nothing else in the package imports this one."""
