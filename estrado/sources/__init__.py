"""Sources: text corpora, file listings, JSON files, and paged listings."""
