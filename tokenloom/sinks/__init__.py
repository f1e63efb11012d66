"""Where reports go: ordered rows as JSON and text."""
