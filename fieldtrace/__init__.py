"""Analytics over wearable-sensor sequences and training corpora, written as Spark jobs."""
