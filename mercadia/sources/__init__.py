"""Tables in and out: schemas, CSV and Parquet zones, warehouse writes."""
