"""Where rows come from and go to: snapshot store, delimited files, the null sink."""
