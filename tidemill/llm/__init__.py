"""Training-data operators: secrets, quality, decontamination, packing, dedup, token files, WARC."""
