"""Training-data operators: token files, near-duplicates, quality, licences, URLs, language,
packing, passages, personal data and benchmark leaks. Nothing outside this folder imports it."""
