"""Sources and sinks: file trees, containers, and virtual trees over tables."""
