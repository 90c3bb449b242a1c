"""Analytics over chemical-safety documents, as Spark plans."""
