"""quadlake: a Spark-native engine for records, named-graph quads, rules, shapes and SPARQL."""
