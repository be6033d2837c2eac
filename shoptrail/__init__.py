"""Shopping-journey analytics on Spark: orders, sessions, tracking audit, funnels, experiments, weekly KPIs."""
