"""Ready-made queries over the test tables."""
