"""Empty: the workload has no operator on streams."""
