"""plumbline: research-integrity analytics expressed as Spark DataFrame plans."""
