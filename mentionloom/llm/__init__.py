"""Training-data operators: sharding, quality, personal data, language, packing, near-duplicates,
source mixing, language-model scores, token files and the shingle similarity join.

Nothing else in the library imports this subpackage."""
