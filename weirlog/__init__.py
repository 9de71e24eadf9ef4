"""weirlog: typed rule programs over relations, compiled to Spark DataFrame plans."""
