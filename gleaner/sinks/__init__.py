"""Writers for curated datasets and their working tables."""
