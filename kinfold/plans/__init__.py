"""The queries of the engine over the driver's tables, with the SQL that must give the same rows."""
