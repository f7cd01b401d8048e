"""linkloom: saved-link analytics and corpus curation on PySpark."""

__version__ = "0.1.0"
