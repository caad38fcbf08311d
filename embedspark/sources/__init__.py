"""Sources and sinks: request tables, payload bytes, image files, metadata, logs, results."""
