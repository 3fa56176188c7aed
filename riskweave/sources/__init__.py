"""Sources: model files in XML as tables of nodes, paths, casts."""
