"""Transaction-traffic analytics and text preparation on Spark."""
