"""Document-query analytics on Spark: filters, pipelines, expressions, updates and change history as lazy DataFrame plans."""

__version__ = "0.1.0"

from docweave.sources.database import Collection, Cursor, Database  # noqa: E402
from docweave.sources.tables import read_json, read_parquet, read_tables  # noqa: E402
from docweave.values import Timestamp  # noqa: E402

__all__ = ["Collection", "Cursor", "Database", "Timestamp", "read_json", "read_parquet", "read_tables"]
