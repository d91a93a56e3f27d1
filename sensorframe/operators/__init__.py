"""DataFrame-to-DataFrame operators over runs."""
