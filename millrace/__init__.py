"""millrace: ordered tables, geometry and activity analytics as Spark DataFrame plans."""
