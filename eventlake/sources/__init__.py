"""Sources: driver tables, adapters to the event model, text/JSON parsers, generators."""
