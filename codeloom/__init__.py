"""Code analytics and corpus preparation as relations on Spark."""
