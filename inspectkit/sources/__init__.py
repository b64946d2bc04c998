"""Sources: parquet test tables, CSV text, JDBC databases."""

from inspectkit.sources.files import (  # noqa: F401
    list_jdbc_tables,
    quote_identifier,
    files_not_utf8,
    read_jdbc_query,
    read_jdbc_table,
    read_quality_csv,
)
from inspectkit.sources.tables import (  # noqa: F401
    TABLES,
    events_raw,
    events_to_raw,
    load_fact,
    quality_raw,
    read_table,
)
