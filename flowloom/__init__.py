"""flowloom: network-flow analytics and data preparation as declarative Spark plans."""
