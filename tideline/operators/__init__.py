"""DataFrame -> DataFrame operators on sample, class, boundary and label tables."""
