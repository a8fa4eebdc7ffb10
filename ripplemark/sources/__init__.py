"""Reading and writing: tick tables, raw hourly bodies, the daily table."""
