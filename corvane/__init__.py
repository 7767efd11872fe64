"""corvane: faceted search, tag closure, rollups and import pipelines as Spark DataFrame operators."""
