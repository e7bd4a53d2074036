"""Sources and sinks of sequence collections."""
