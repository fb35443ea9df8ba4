"""DataFrame-to-DataFrame operators over whole tables."""
