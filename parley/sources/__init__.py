"""Sources and sinks: JSON lines, annotation XML, transcripts, releases."""
