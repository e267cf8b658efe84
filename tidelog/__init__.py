"""tidelog: change-log analytics on Spark."""
