"""oddsmith: race-result features, closing-odds prediction and evaluation as Spark jobs."""
