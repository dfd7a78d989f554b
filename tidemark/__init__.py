"""Analytics for binary-outcome event contracts, written for Spark."""
