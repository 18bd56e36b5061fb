"""Point-in-time analytics, forecast calibration and market audits on Spark."""
