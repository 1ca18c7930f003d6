"""tessera: Spark-first operators for barcoded co-culture experiments and paired-outcome data."""
