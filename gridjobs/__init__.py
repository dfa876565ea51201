"""gridjobs: Spark jobs for hourly power-grid data."""
