"""DataFrame operators: cleaning, sampling, statistics, features, models, metrics, run tables."""
