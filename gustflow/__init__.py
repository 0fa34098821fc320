"""PySpark-native analytics for station panels, gridded predictors and training corpora."""
