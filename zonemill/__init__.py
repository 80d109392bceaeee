"""Service-area and delivery-zone analytics on Spark DataFrames."""
