"""River water-quality analytics as DataFrame -> DataFrame functions on Spark."""
