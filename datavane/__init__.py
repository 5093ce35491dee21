"""datavane: catalogue, lineage, quality, linkage and network analytics as Spark jobs."""
