"""eventlens: resource and bottleneck analysis of Spark event logs, as DataFrame jobs."""
