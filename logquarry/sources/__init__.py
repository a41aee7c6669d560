"""Where logs, messages and alerts are read from and written to."""
