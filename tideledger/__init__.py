"""tideledger: point-in-time ledger, accounting and risk analytics on Spark."""
