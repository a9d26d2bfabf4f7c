"""Training-data pipeline operators (BPE, packing, toxicity, quality, near
duplicates, rules). Nothing else in the library imports this subpackage."""
