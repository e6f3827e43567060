"""Search and text analytics over collections of semi-structured documents, on Spark."""
