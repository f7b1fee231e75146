"""Analytics over governed document knowledge, as DataFrame, SQL and Structured Streaming operators."""
