"""Factor catalogues and the research cycle."""
