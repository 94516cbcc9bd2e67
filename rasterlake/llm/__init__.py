"""Training-data operators: sharding, decontamination, URL lists, LM scoring,
fingerprints, line deduplication, HTML extraction, packing, toxicity and
similarity joins. Nothing else in the library imports this subpackage."""
