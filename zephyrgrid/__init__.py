"""Spark operators for gridded weather forecasts, turbine sensors and settlement scores."""
