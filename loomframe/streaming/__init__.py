"""Pull iteration over tables, and Structured Streaming over folders of files."""
