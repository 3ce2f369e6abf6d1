"""graphloom: a Spark-native store for collections of attributed graphs."""
