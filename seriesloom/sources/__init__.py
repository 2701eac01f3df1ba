"""Reading, column resolution, series derived from event tables, sinks."""
