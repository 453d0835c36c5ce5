"""An analytics engine for text de-identification and corpus preparation on Spark."""
