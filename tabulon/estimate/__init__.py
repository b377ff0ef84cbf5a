"""Regression estimators: distributed sums, small algebra on the driver."""
