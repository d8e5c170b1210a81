"""Operations of a training-data pipeline, each by a named method."""
