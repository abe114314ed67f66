"""A table-knowledge engine on PySpark: messy tables in, typed, linked, stitched and scored relations out."""
