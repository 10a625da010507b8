"""Contract supply-chain analytics on Spark."""
