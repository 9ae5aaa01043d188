"""Column helpers, quantiles, moments and distribution tails."""
