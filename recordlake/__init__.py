"""recordlake: Spark jobs over versioned public text records and the registers around them."""
