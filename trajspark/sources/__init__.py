"""Sources and sinks: driver tables, JSONL trajectory buffers, value tables, manifests."""
