"""Functions of the node, voxel and brick tables."""
