"""loomset: multimodal data preparation as Spark DataFrame operators."""
