"""Market analytics expressed as Spark jobs over long tables of many instruments and accounts."""
