"""tastevin: a catalogue search and maintenance engine on Spark DataFrames."""
