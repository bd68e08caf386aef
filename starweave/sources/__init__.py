"""Reading and writing models, views and their metadata."""
