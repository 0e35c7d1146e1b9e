"""Reading and writing containers of named-axis datasets."""
