"""quarrystone: text-dataset and experiment pipelines on the Spark DataFrame API."""
