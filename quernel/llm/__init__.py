"""Training-data operators: tokenisation, quality, deduplication, decontamination, sharding and scans."""
