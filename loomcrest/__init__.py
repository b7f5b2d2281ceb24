"""loomcrest: a Spark-first engine for corpus curation, retrieval and evaluation."""
