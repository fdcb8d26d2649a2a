"""The continuous job and its progress table."""
