"""Column functions: header cards and image samples."""
