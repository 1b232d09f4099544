"""tallyhelix: cohort copy-number analysis as Spark DataFrame plans."""
