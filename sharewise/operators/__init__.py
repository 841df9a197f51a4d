"""The operators: cleaning, sampling, features, models, densities, calibration, metrics, votes."""
