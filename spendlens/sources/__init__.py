"""Sources: model tables from parquet/JDBC, and the driver-table fixture mapping."""
