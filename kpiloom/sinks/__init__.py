"""Writers of the clean datasets and of the two tables."""
