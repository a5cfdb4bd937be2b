"""plumbline: a PySpark engine that evaluates and cleans bilingual model answers."""

__version__ = "0.1.0"
