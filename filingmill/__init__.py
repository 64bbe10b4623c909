"""Filing signals on Spark: filings to scores, scores to signals, signals to portfolios, as DataFrame jobs."""
