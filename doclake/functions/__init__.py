"""Column functions; everything here stays inside Catalyst unless the name says ``udf``."""
