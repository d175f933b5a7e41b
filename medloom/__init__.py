"""medloom: clinical text analytics expressed as Spark plans."""
