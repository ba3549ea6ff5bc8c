"""Document analytics on Spark: segmentation, passages, ranking, verdicts and summaries over whole corpora."""
