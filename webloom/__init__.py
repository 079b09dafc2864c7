"""webloom: web-page and text analytics as PySpark DataFrame transformations."""
