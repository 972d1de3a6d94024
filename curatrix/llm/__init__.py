"""Training-data operators: WARC, nearest neighbours, deduplication, filters, packing, scoring."""
