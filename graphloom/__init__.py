"""graphloom: property-graph analytics and text processing on Apache Spark."""
