"""DataFrame-to-DataFrame operators, grouped by the step they belong to."""
