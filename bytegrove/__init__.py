"""bytegrove: identify, filter, analyse and recursively extract content with Spark."""
