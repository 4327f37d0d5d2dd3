"""Training-data operators: language ID, HTML extraction, licence scans, sharding,
URL filters, near-duplicates, language models, tokenisation, decontamination and
quality rules.  Nothing else in the package imports this subpackage."""
