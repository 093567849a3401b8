"""Operations of a training-data pipeline: dedup, packing, mixing, search, archives, extraction."""
