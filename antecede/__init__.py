"""Point-in-time features over event logs, declared as Spark plans."""
