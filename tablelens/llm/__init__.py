"""Training-data operators: scans, filters, fingerprints, language models, archives, mixing."""
