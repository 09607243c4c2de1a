"""Sources and sinks: delimited discharge files, the fact table, summaries, fixtures."""
