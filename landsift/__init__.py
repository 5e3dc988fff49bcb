"""landsift: public-records analytics on Spark."""
