"""Training-data operators (packing, filters, dedup, fingerprints ...); nothing else imports this package."""
