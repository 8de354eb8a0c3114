"""Search, index, layout, quality and registry operators."""
