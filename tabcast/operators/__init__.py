"""DataFrame operators: typing, profiling, association, encoding, regression, scenarios."""
