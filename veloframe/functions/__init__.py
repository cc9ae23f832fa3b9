"""Column functions: time, cleaning, units, buckets, weather, polylines."""
