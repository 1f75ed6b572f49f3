"""Training-data operators: deduplication, sharding, language, contamination,
fingerprints, toxicity, WARC, pieces and personal data. Nothing else in the library
imports this subpackage."""
