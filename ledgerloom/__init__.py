"""ledgerloom: document-to-ledger reconciliation as Spark jobs."""
