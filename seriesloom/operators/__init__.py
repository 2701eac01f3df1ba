"""DataFrame-to-DataFrame steps: positions, cleaning, features, splits, windows, models, metrics."""
