"""Operations of a training-data pipeline: filters, duplicate search, mixing, sharding, counting and packing."""
