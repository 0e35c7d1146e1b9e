"""Named-axis scientific data on Spark: arrays as rows of cells, axes as columns of positions."""
