"""Training-data operators: packing, near and exact duplicates, quality, language-model
scores, WARC, nearest neighbours, token counts and source mixing. Nothing else in
the library imports this subpackage."""
