"""editrail: follow long structured documents from edition to edition, on Spark."""

__version__ = "0.1.0"
