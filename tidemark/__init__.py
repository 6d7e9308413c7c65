"""Analytics over dated market-strength snapshots, on Spark."""
