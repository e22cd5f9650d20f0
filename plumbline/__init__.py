"""Evidence-based question answering and trust scoring as Spark DataFrame operators."""

__version__ = "0.1.0"
