"""Analytics over large media libraries, expressed as Spark DataFrame plans."""
