"""Column functions: text, parsing, chunking, citations and quality flags."""
