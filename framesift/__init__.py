"""framesift: burst culling and corpus preparation as declarative Spark plans."""
