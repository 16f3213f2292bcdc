"""Table scans, fixture views over the test tables, file sources and sinks."""
