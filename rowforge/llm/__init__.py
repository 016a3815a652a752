"""Operations of a training-data pipeline: archives, deduplication, tokenizing, privacy, sharding, mixing, scoring."""
