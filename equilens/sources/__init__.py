"""Sources and sinks: table loading, fixture views, result writers."""
