"""Sources and sinks: driver tables, the quotes view, CSV scan, writers."""
