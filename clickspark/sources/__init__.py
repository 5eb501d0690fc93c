from clickspark.sources.files import (  # noqa: F401
    read_events_csv, split_corrupt, convert_csv_to_parquet, write_clean_parquet, write_csv, write_json,
    source_inventory, output_manifest, read_clean_parquet,
)
