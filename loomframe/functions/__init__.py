"""Value-level expressions: typing, trimming, quoting and escaping, all built from Catalyst functions."""
