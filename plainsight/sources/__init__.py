"""Sources and sinks: delimited text, JSON documents, landed pages, HTML tables, dimensions."""
