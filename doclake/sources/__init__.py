"""Files, decoded input and tables: scans, section builders, sinks."""
