"""Training-data operators: quality, extraction, sharding, deduplication, language, decontamination, licences, mixing."""
