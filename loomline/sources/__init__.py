"""Where tables are kept: snapshots of Parquet parts named by an atomically replaced manifest."""
