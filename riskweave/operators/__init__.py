"""DataFrame-in, DataFrame-out operators of the engine."""
