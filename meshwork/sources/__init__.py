"""Sources and sinks: the graph store, file formats, scratch tables."""
