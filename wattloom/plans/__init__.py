"""Settings, layer pipelines and registered queries."""
