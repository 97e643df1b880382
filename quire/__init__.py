"""A Spark engine that turns documents into ordered, classified, context-aware units of work."""
