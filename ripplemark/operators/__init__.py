"""DataFrame operators: sampling, variance measures, features, forecasts, comparison."""
