"""Sources and sinks: generators, GeoJSON, Parquet and binary interchange files."""
