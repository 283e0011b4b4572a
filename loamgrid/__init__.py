"""loamgrid: text geolocation, temporal corpus comparison and corpus preparation on PySpark."""
