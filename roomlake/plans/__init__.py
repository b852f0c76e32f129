"""Plans: named relations over scene tables, composed into one query for Catalyst."""
