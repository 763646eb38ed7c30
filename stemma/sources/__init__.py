"""Where rows come from: files, saved graphs, recordings, tables."""
