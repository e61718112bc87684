"""provenlace: evidence-graph analytics expressed as Spark DataFrame plans."""
