"""DataFrame-to-DataFrame operators: joins, sessions, windows and reports."""
