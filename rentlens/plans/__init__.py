"""The analyses. Each function takes a workspace and returns a DataFrame."""
