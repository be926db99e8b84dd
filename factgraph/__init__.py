"""Program-fact analytics on Spark."""
