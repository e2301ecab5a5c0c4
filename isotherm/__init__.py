"""Analytics over long daily climate series of many stations, as Spark DataFrame operators."""
