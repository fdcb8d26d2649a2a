"""DataFrame-to-DataFrame operators, for batch and stream unless stated otherwise."""
