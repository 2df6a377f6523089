"""Change-impact analytics over code-property graphs, as Spark plans."""
