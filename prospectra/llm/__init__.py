"""Training-data operators: fingerprints, filters, joins, token work, mixing, chat, scans and language-model scores."""
