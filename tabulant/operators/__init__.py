"""DataFrame -> DataFrame operators (aggregate, panel, rank, join, stats, score, shape)."""
